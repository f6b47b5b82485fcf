"""Clinical-text analytics expressed as Spark column expressions and DataFrame plans."""

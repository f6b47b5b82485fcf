"""Notes as a stream: the same column expressions over readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import deid, extract


def structured(notes: DataFrame) -> DataFrame:
    """Spans, redacted text and record of a stream of notes; every step is row-local, so there is no state to keep."""
    return extract.with_record(deid.with_pii(notes))

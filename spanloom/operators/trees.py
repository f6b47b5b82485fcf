"""Tree ensembles to compare with the logistic models; trained with pyspark.ml, federated as the size-weighted mean of site models."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v


def _ready(data: DataFrame) -> DataFrame:
    return data.withColumns({"_features": array_to_vector(F.col("x")), "_label": F.col("y").cast("double")})


def _forest(data: DataFrame, trees: int):
    return RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, seed=v.SEED, probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r").fit(_ready(data))


def _scored(model, test: DataFrame, name: str) -> DataFrame:
    return model.transform(_ready(test)).withColumn(name, vector_to_array("_p")[1]).drop("_features", "_label", "_p", "_c", "_r")


def random_forest(train: DataFrame, test: DataFrame, trees: int = 100) -> DataFrame:
    return _scored(_forest(train, trees), test, "p")


def gradient_boosting(train: DataFrame, test: DataFrame, rounds: int = 50) -> DataFrame:
    m = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=rounds, seed=v.SEED, probabilityCol="_p", predictionCol="_c", rawPredictionCol="_r").fit(_ready(train))
    return _scored(m, test, "p")


def federated_forest(train: DataFrame, test: DataFrame, trees: int = 100) -> DataFrame:
    """Each site grows its own forest; probabilities are averaged by site size. A handful of sites, one model each."""
    sizes = {r["site"]: r["n"] for r in train.groupBy("site").agg(F.count(F.lit(1)).alias("n")).orderBy("site").collect()}
    out, total = test.withColumn("p", F.lit(0.0)), sum(sizes.values())
    for site, n in sizes.items():
        out = _scored(_forest(train.filter(F.col("site") == site), trees), out, "_site_p")
        out = out.withColumn("p", F.col("p") + F.col("_site_p") * (n / total)).drop("_site_p")
    return out


def balanced_weights(data: DataFrame) -> DataFrame:
    """`data` with weight: rows / (2 * rows of the class)."""
    sizes = data.groupBy("y").agg(F.count(F.lit(1)).alias("_n"))
    total = data.agg(F.count(F.lit(1)).alias("_all"))
    return data.join(F.broadcast(sizes), "y").join(F.broadcast(total)).withColumn("weight", F.col("_all") / (2.0 * F.col("_n"))).drop("_n", "_all")

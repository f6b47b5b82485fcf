"""Folds, out-of-fold studies and selection rules. Folds are columns, so all fits of a study share every pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from . import metrics, models


def stratified_folds(rows: DataFrame, k: int, seeds: tuple[int, ...] = (v.SEED,), site: str = "site", y: str = "y", row_id: str = "row_id", buckets: int = 64) -> DataFrame:
    """`rows` for each seed with fold: within each (site, y) a keyed shuffle dealt round robin, the offset carried over strata.

    The place of a row in its stratum is counted in two steps, within hash buckets and over bucket sizes, so that no
    task sorts a whole stratum: order is by bucket, then hash, then id.
    """
    salted = rows.withColumn("seed", F.explode(F.array(*map(F.lit, seeds))))
    order = F.xxhash64(row_id, "seed")
    salted = salted.withColumns({"_h": order, "_b": F.pmod(order, F.lit(buckets))})
    sizes = salted.groupBy("seed", site, y, "_b").agg(F.count(F.lit(1)).alias("_n"))  # strata * buckets rows
    before = Window.partitionBy("seed").orderBy(site, y, "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy("seed", site, y, "_b").orderBy("_h", row_id)
    placed = salted.withColumn("_i", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["seed", site, y, "_b"])
    # Stratum s starts dealing where the one before stopped, so the carried offset is its start: start + i covers both.
    return placed.withColumn("fold", ((F.col("_start") + F.col("_i")) % k).cast("int")).drop("_h", "_b", "_i", "_start")


def plain_folds(rows: DataFrame, k: int, seeds: tuple[int, ...] = (v.SEED,), row_id: str = "row_id", buckets: int = 64) -> DataFrame:
    """`rows` for each seed with fold, dealt round robin after a keyed shuffle of all rows."""
    one = rows.withColumns({"_site": F.lit(0), "_y": F.lit(0)})
    return stratified_folds(one, k, seeds, "_site", "_y", row_id, buckets).drop("_site", "_y")


def training_sets(folded: DataFrame, k: int) -> DataFrame:
    """Each row once for every fold that it trains: `folded` with held_out, the fold that is left out."""
    return folded.withColumn("held_out", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter("held_out <> fold")


def out_of_fold(folded: DataFrame, k: int, kind: str = "federated", **options) -> DataFrame:
    """`folded` (seed, fold, site, x, y) with p from the model that did not see the row; kind: local, federated, centralized or private."""
    read = {"seed", "fold", "site", "x", "y", options.get("weight")}
    train = folded.select(*[c for c in folded.columns if c in read])
    options = {"expand": lambda rows: training_sets(rows, k)} | options
    if kind == "local":
        keys = ("seed", "held_out", "site")
        weights = models.newton_fit(train, keys, **options)
    elif kind == "centralized":
        keys = ("seed", "held_out")
        weights = models.newton_fit(train, keys, **options)
    else:
        keys = ("seed", "held_out")
        if kind == "private":
            options = {"clip": v.CLIP, "noise": v.SIGMA, "rounds": v.STEPS, "rate": v.LEARNING_RATE, "l2": v.L2} | options
        weights = models.fedavg(train, keys, **options)
    return models.scored(folded.withColumn("held_out", F.col("fold")), weights, keys).drop("held_out")


def cross_validated(folded: DataFrame, k: int, kinds: tuple[str, ...] = ("local", "federated", "centralized"), **options) -> DataFrame:
    """model, seed and the ranking metrics of each repeat."""
    parts = [metrics.ranking_metrics(out_of_fold(folded, k, kind, **options), ("seed",)).withColumn("model", F.lit(kind)) for kind in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def leave_one_site_out(rows: DataFrame) -> DataFrame:
    """Each row once for every site that it trains against: `rows` with held_out_site. The number of sites is small."""
    sites = rows.select(F.col("site").alias("held_out_site")).distinct()
    return rows.join(F.broadcast(sites), F.col("site") != F.col("held_out_site"))


def grid(spark, **axes) -> DataFrame:
    """All settings of a study."""
    out = None
    for name, values in axes.items():
        axis = spark.createDataFrame([(float(x),) for x in values], f"{name} double")
        out = axis if out is None else out.crossJoin(axis)  # a few values by a few values
    return out


def selected(results: DataFrame, value: str, margin: float, then: list[Column]) -> DataFrame:
    """The row with the least value; all within `margin` of it are tied and `then` decides."""
    least = results.agg(F.min(value).alias("_least"))
    return results.join(F.broadcast(least)).filter(F.col(value) <= F.col("_least") + margin).drop("_least").orderBy(*then).limit(1)


def reference_setting(results: DataFrame, least_auc: float = 0.683) -> DataFrame:
    """Of the noisy settings whose mean AUC less its sd stays above, the one with the least epsilon, then the highest AUC."""
    return results.filter((F.col("sigma") > 0) & (F.col("auc_mean") - F.col("auc_sd") > least_auc)).orderBy("epsilon", F.desc("auc_mean")).limit(1)


def max_difference(a: DataFrame, b: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Largest change of a single probability between two models."""
    return a.select(row_id, F.col("p").alias("_p")).join(b.select(row_id, F.col("p").alias("_q")), row_id).agg(F.max(F.abs(F.col("_p") - F.col("_q"))).alias("max_abs_difference"))

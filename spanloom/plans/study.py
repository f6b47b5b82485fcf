"""The studies around the model: choice of settings, nested check, ablations, stability, privacy sweep, leakage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..operators import features, folds, metrics, models

METRICS = ("roc_auc", "average_precision", "brier_score", "log_loss")


def _repeats(folded: DataFrame, k: int, **options) -> DataFrame:
    return metrics.ranking_metrics(folds.out_of_fold(folded, k, **options), ("seed",))


def settings_grid(rows: DataFrame, c_grid: tuple = v.C_GRID, round_grid: tuple = v.ROUND_GRID, seeds: tuple[int, ...] = v.STUDY_SEEDS, k: int = 5) -> DataFrame:
    """c, rounds and the mean metrics. One training per C serves all its round counts, seeds and folds."""
    folded, train_keys = folds.stratified_folds(rows, k, seeds).cache(), ("seed", "held_out")
    train = folds.training_sets(folded, k).cache()
    parts = []
    for c in c_grid:
        kept: dict[int, dict] = {}
        models.fedavg(train, train_keys, rounds=max(round_grid), c=float(c), on_round=lambda r, w: kept.update({r: w}) if r in round_grid else None)
        for r in round_grid:
            p = models.scored(folded.withColumn("held_out", F.col("fold")), kept[r], train_keys)
            parts.append(metrics.ranking_metrics(p, ("seed",)).agg(*[F.avg(m).alias(m) for m in METRICS]).withColumns({"c": F.lit(float(c)), "rounds": F.lit(float(r))}))
    return _union(parts)


def chosen_settings(grid: DataFrame) -> DataFrame:
    """Least log loss; within 0.002 of it fewer rounds, then the smaller C."""
    return folds.selected(grid, "log_loss", 0.002, [F.col("rounds"), F.col("c")])


def nested_check(rows: DataFrame, seed: int = v.SEED, outer: int = 5, inner: int = 3, c_grid: tuple = v.C_GRID, round_grid: tuple = (50,)) -> tuple[DataFrame, dict[float, int]]:
    """Metrics with the settings chosen inside each outer training set, and how often each C was chosen."""
    folded = folds.stratified_folds(rows, outer, (seed,)).cache()
    parts, picks = [], {}
    for f in range(outer):
        train = folded.filter(F.col("fold") != f).drop("seed", "fold")
        best = chosen_settings(settings_grid(train, c_grid, round_grid, (seed + 1000,), inner)).first()
        picks[best["c"]] = picks.get(best["c"], 0) + 1
        w = models.fedavg(train, rounds=int(best["rounds"]), c=best["c"])
        parts.append(models.scored(folded.filter(F.col("fold") == f), w).select("y", "p"))
    return metrics.ranking_metrics(_union(parts)), picks


def ablations(cases: DataFrame, subsets: dict[str, tuple[str, ...]], seeds: tuple[int, ...] = v.STUDY_SEEDS, k: int = 5, **options) -> DataFrame:
    """`cases` has a column for each feature, row_id, site and y; a row of means and sds for each subset of features."""
    parts = []
    for name, keep in subsets.items():
        rows = cases.select("row_id", "site", "y", features.vector(keep).alias("x"))
        parts.append(_repeats(folds.stratified_folds(rows, k, seeds), k, **options).withColumn("features", F.lit(name)))
    return metrics.mean_sd(_union(parts), ("features",), METRICS)


def start_stability(rows: DataFrame, seeds: tuple[int, ...] = v.STUDY_SEEDS, **options) -> DataFrame:
    """Largest change of any probability between the zero start and random ones."""
    zero = models.scored(rows, models.fedavg(rows, **options)).select("row_id", "p")
    d = len(rows.select("x").first()["x"])
    parts = []
    for s in seeds:
        start = {(): np.random.default_rng(s).normal(0, 0.5, d)}
        parts.append(folds.max_difference(zero, models.scored(rows, models.fedavg(rows, start=start, **options))).withColumn("seed", F.lit(s)))
    return _union(parts)


def leave_one_site_out(rows: DataFrame, **options) -> DataFrame:
    """held_out_site and the metrics there of a model that never saw it; all sites share each round."""
    w = models.fedavg(folds.leave_one_site_out(rows), ("held_out_site",), **options)
    return metrics.ranking_metrics(models.scored(rows.withColumn("held_out_site", F.col("site")), w, ("held_out_site",)), ("held_out_site",))


def learning_rate(rows: DataFrame, rates: tuple = v.RATE_GRID, seeds: tuple[int, ...] = (v.SEED,), k: int = 5) -> DataFrame:
    """The step size with the least log loss without noise; ties go to the smaller."""
    folded = folds.stratified_folds(rows, k, seeds).cache()
    parts = [_repeats(folded, k, kind="private", noise=0.0, clip=1e6, rate=float(r)).agg(F.avg("log_loss").alias("log_loss")).withColumn("rate", F.lit(float(r))) for r in rates]
    return folds.selected(_union(parts), "log_loss", 0.0, [F.col("rate")])


def privacy_sweep(rows: DataFrame, clips: tuple = v.CLIP_GRID, sigmas: tuple = v.SIGMA_GRID, steps: tuple = v.STEP_GRID, seeds: tuple[int, ...] = v.STUDY_SEEDS, k: int = 5) -> DataFrame:
    """clip, sigma, rounds, epsilon and the mean and sd of AUC and log loss over repeats of plain folds."""
    folded = folds.plain_folds(rows, k, seeds).cache()
    parts = []
    for clip in clips:
        for sigma in sigmas:
            for t in steps:
                r = _repeats(folded, k, kind="private", clip=float(clip), noise=float(sigma), rounds=int(t))
                one = r.agg(F.avg("roc_auc").alias("auc_mean"), F.stddev_samp("roc_auc").alias("auc_sd"), F.avg("log_loss").alias("log_loss"))
                parts.append(one.withColumns({"clip": F.lit(float(clip)), "sigma": F.lit(float(sigma)), "rounds": F.lit(int(t)), "epsilon": F.lit(models.epsilon(sigma, t))}))
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

"""Relational metrics: spans, sets, numbers, categories and rankings, overall and by group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import render


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1_columns(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall)}


def normal_token(value: Column) -> Column:
    """Trimmed, lower case, - as _, inner white space as one _; null is a token of its own."""
    return F.coalesce(F.regexp_replace(F.replace(F.lower(F.trim(value.cast("string"))), F.lit("-"), F.lit("_")), r"\s+", "_"), F.lit("__NULL__"))


def normal_list(values: Column) -> Column:
    tokens = F.transform(F.coalesce(values, F.array().cast("array<string>")), normal_token)
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: (t != "") & (t != "__NULL__"))))


def numeric(value: Column) -> Column:
    """A finite double or null."""
    n = value.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != F.lit(float("inf"))), n)


# ------------------------------------------------------------------------------------------- spans


def valid_spans(spans: Column, text: Column) -> Column:
    """Within the text and of a known label, sorted by (start, end, label); of overlapping ones the later goes."""
    plain = "array<struct<start:int,end:int,label:string>>"
    inside = lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.length(text)) & s["label"].isin(*v.LABELS)
    sorted_ = F.array_sort(F.filter(F.coalesce(spans, F.array()).cast(plain), inside))
    return F.aggregate(sorted_, F.array().cast(plain), lambda acc, s: F.when((F.size(acc) == 0) | (s["start"] >= F.element_at(acc, -1)["end"]), F.array_append(acc, s)).otherwise(acc))


def span_messages(spans: Column, text: Column) -> Column:
    """What valid_spans leaves out, one message for each such span; none for a missing list."""
    plain = "array<struct<start:int,end:int,label:string>>"
    given = F.coalesce(spans, F.array()).cast(plain)
    outside = lambda s: (s["start"] < 0) | (s["end"] <= s["start"]) | (s["end"] > F.length(text))

    def fault(s: Column, i: Column) -> Column:
        what = F.when(s.isNull(), "is no span").when(s["start"].isNull() | s["end"].isNull(), "lacks whole-number offsets").when(outside(s), "lies outside the note")
        what = what.when(~F.coalesce(s["label"].isin(*v.LABELS), F.lit(False)), F.concat(F.lit("has an unknown label "), F.coalesce(s["label"], F.lit("null"))))
        return F.when(what.isNotNull(), F.concat(F.lit("span "), i.cast("string"), F.lit(" "), what))

    faults = F.filter(F.transform(given, fault), lambda m: m.isNotNull())
    crossed = F.size(given) - F.size(faults) - F.size(valid_spans(spans, text))
    return F.concat(faults, F.array_repeat(F.lit("a span overlaps an earlier one and is left out"), crossed))


def probability_message(p: Column) -> Column:
    """Null for a usable probability."""
    n = numeric(p)
    return F.when(~F.coalesce((n >= 0) & (n <= 1), F.lit(False)), "no probability in 0 .. 1; 0.5 counts")


def _length(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _shared(a: Column, b: Column, same_label: bool) -> Column:
    """Characters in both; no character is ever a row."""

    def one(x: Column) -> Column:
        return F.aggregate(
            b, F.lit(0).cast("long"),
            lambda n, y: n + F.when(F.lit(not same_label) | (x["label"] == y["label"]), F.greatest(F.lit(0), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]))).otherwise(0),
        )

    return F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + one(x))


def span_counts(cases: DataFrame, text: str = "note_text", true: str = "true_spans", pred: str = "pred_spans", rendered: str | None = "deidentified_text") -> DataFrame:
    """`cases` with per-case counts of characters, labelled characters and entities; both span columns validated first."""
    df = cases.withColumns({"_t": valid_spans(F.col(true), F.col(text)), "_p": valid_spans(F.col(pred), F.col(text))})
    t, p = F.col("_t"), F.col("_p")
    both, same = _shared(t, p, False), _shared(t, p, True)
    hits = F.size(F.array_intersect(t, p))
    exact = (F.col(rendered) == render(F.col(text), p)) if rendered else F.lit(True)
    return df.withColumns(
        {
            "char_tp": both, "char_fp": _length(p) - both, "char_fn": _length(t) - both,
            "label_tp": same, "label_fp": _length(p) - same, "label_fn": _length(t) - same,
            "entity_tp": hits, "entity_fp": F.size("_p") - hits, "entity_fn": F.size("_t") - hits,
            "render_exact": F.coalesce(exact, F.lit(False)).cast("int"),
        }
    )


def entity_f1_by_label(counts: DataFrame) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 for all labels, those without any included."""
    pick = lambda c, name: counts.select(F.explode(c).alias("s")).groupBy("s.label").count().withColumnRenamed("count", name)
    labels = counts.sparkSession.createDataFrame([(x,) for x in v.LABELS], "label string")
    t, p = F.col("_t"), F.col("_p")
    out = F.broadcast(labels)
    for c, name in ((F.array_intersect(t, p), "tp"), (F.array_except(p, t), "fp"), (F.array_except(t, p), "fn")):
        out = out.join(pick(c, name), "label", "left")
    return out.fillna(0).withColumns(f1_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def deid_scores(counts: DataFrame) -> DataFrame:
    """One row: the character, labelled and entity metrics, leakage, false discovery, rendering, macro F1 and their composite."""
    names = [f"{k}_{x}" for k in ("char", "label", "entity") for x in ("tp", "fp", "fn")]
    one = counts.agg(*[F.sum(n).alias(n) for n in names], F.avg("render_exact").alias("render_exact_rate"), F.count(F.lit(1)).alias("n"))
    for k in ("char", "label", "entity"):
        one = one.withColumns({f"{k}_{m}": c for m, c in f1_columns(*[F.col(f"{k}_{x}") for x in ("tp", "fp", "fn")]).items()})
    macro = entity_f1_by_label(counts).agg(F.avg("f1").alias("macro_f1"))
    score = 0.55 * F.col("char_f1") + 0.25 * F.col("entity_f1") + 0.15 * F.col("label_f1") + 0.05 * F.col("render_exact_rate")
    return one.withColumns({"leakage_rate": ratio(F.col("char_fn"), F.col("char_tp") + F.col("char_fn")), "false_discovery_rate": ratio(F.col("char_fp"), F.col("char_tp") + F.col("char_fp")), "score": score}).join(F.broadcast(macro))


# ------------------------------------------------------------------------------------------- fields


def set_f1(true: Column, pred: Column) -> dict[str, Column]:
    """Micro-averaged aggregates over cases."""
    t, p = normal_list(true), normal_list(pred)
    tp, fp, fn = (F.sum(F.size(c(x, y))) for c, x, y in ((F.array_intersect, t, p), (F.array_except, p, t), (F.array_except, t, p)))
    return {"tp": tp, "fp": fp, "fn": fn, **f1_columns(tp, fp, fn)}


def tolerance_score(true: Column, pred: Column, tolerance: float) -> Column:
    """1 if both are missing or within tolerance, falling to 0 at three times it; 0 if one is missing."""
    t, p = numeric(true), numeric(pred)
    error = F.abs(p - t)
    return (
        F.when(t.isNull() & p.isNull(), 1.0).when(t.isNull() | p.isNull(), 0.0).when(error <= tolerance, 1.0)
        .otherwise(F.greatest(F.lit(0.0), 1.0 - (error - tolerance) / (2.0 * tolerance)))
    )


def extraction_scores(cases: DataFrame, true: str = "truth", pred: str = "prediction") -> DataFrame:
    """One row: F1 of both sets, score, hit rate and mean error of each number, accuracy of each category, and the composite."""
    t, p = (lambda f: F.col(f"{true}.{f}")), (lambda f: F.col(f"{pred}.{f}"))
    out: dict[str, Column] = {}
    for f in ("diagnoses", "medications"):
        out |= {f"{f}_{k}": c for k, c in set_f1(t(f), p(f)).items()}
    for f, tolerance in v.TOLERANCE.items():
        score = tolerance_score(t(f), p(f), tolerance)
        out |= {f"{f}_score": F.coalesce(F.avg(score), F.lit(0.0)), f"{f}_within": F.coalesce(F.avg((score == 1.0).cast("double")), F.lit(0.0)), f"{f}_mae": F.avg(F.abs(numeric(t(f)) - numeric(p(f))))}
    for f in ("smoking_status", "allergy"):
        out[f"{f}_accuracy"] = F.coalesce(F.avg((normal_token(t(f)) == normal_token(p(f))).cast("double")), F.lit(0.0))
    one = cases.agg(*[c.alias(k) for k, c in out.items()])
    numbers = sum((F.col(f"{f}_score") for f in v.TOLERANCE), F.lit(0.0)) / len(v.TOLERANCE)
    categories = (F.col("smoking_status_accuracy") + F.col("allergy_accuracy")) / 2
    return one.withColumns({"numeric_average": numbers, "categorical_average": categories, "score": 0.22 * F.col("diagnoses_f1") + 0.22 * F.col("medications_f1") + 0.40 * numbers + 0.16 * categories})


# ------------------------------------------------------------------------------------------- rankings


def valid_probability(p: Column) -> Column:
    """0.5 where missing or outside 0 .. 1."""
    n = numeric(p)
    return F.when((n >= 0) & (n <= 1), n).otherwise(0.5)


def ranking_metrics(rows: DataFrame, keys: tuple[str, ...] = (), y: str = "y", p: str = "p") -> DataFrame:
    """keys, n, prevalence, roc_auc, average_precision, brier_score, log_loss.

    First to one row per distinct probability and key (partial sums before the shuffle), then windows over those:
    what a window sees are distinct scores, and the ranks of ties come from their counts. AUC is null with one
    class only, average precision 0 without positives.
    """
    keys = list(keys)
    q = F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), F.col("_p")))
    flat = rows.select(*keys, F.col(y).cast("double").alias("_y"), F.col(p).cast("double").alias("_p"))
    loss = -(F.col("_y") * F.ln(q) + (1 - F.col("_y")) * F.ln(1 - q))
    scores = flat.groupBy(*keys, "_p").agg(
        F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_y").alias("_pos"), F.sum((F.col("_p") - F.col("_y")) ** 2).alias("_brier"), F.sum(loss).alias("_loss")
    )
    up = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*keys).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0)
    below = F.coalesce(F.sum("_n").over(up), F.lit(0.0))
    ranked = scores.withColumns({"_rank": below + (F.col("_n") + 1) / 2, "_tp": F.sum("_pos").over(down), "_k": F.sum("_n").over(down)})
    n, pos = F.sum("_n"), F.sum("_pos")
    neg = n - pos
    return ranked.groupBy(*keys).agg(
        n.cast("long").alias("n"), (pos / n).alias("prevalence"),
        F.when((pos > 0) & (neg > 0), (F.sum(F.col("_pos") * F.col("_rank")) - pos * (pos + 1) / 2) / (pos * neg)).alias("roc_auc"),
        F.when(pos > 0, F.sum(F.col("_pos") * F.col("_tp") / F.col("_k")) / pos).otherwise(0.0).alias("average_precision"),
        (F.sum("_brier") / n).alias("brier_score"), (F.sum("_loss") / n).alias("log_loss"),
    )


def prediction_scores(rows: DataFrame, site: str = "site") -> DataFrame:
    """One row: overall metrics, the worst site's AUC, and the composite."""
    worst = ranking_metrics(rows, (site,)).agg(F.min("roc_auc").alias("worst_site_roc_auc"))
    score = 0.55 * F.coalesce("roc_auc", F.lit(0.5)) + 0.25 * F.col("average_precision") + 0.20 * (1 - F.col("brier_score"))
    return ranking_metrics(rows).withColumn("score", score).join(F.broadcast(worst))


def overall_score(deid, extraction, prediction) -> dict:
    """Of three columns or of three numbers."""
    return {"overall": 0.375 * deid + 0.375 * extraction + 0.25 * prediction, "points": 15 * deid + 15 * extraction + 10 * prediction}


def mean_sd(rows: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """Mean and sample standard deviation over repeats."""
    of: list[tuple[str, Callable]] = [("mean", F.avg), ("sd", F.stddev_samp)]
    return rows.groupBy(*keys).agg(*[f(c).alias(f"{c}_{name}") for c in columns for name, f in of])

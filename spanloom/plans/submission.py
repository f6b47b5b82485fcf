"""The main plan: cases in, predictions out; training, evaluation and summaries beside it."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as v
from ..functions.text import render
from ..operators import deid, extract, features, folds, metrics, models
from ..sources import jsonl


log = logging.getLogger(__name__)
SUMMARY_SEEDS = v.STUDY_SEEDS[:3]
Step = Callable[[DataFrame], DataFrame]


def training_rows(cases: DataFrame) -> DataFrame:
    """row_id, site, x, y of labelled cases (labels.readmission_30d, or readmission_30d)."""
    label = F.col("labels.readmission_30d") if "labels" in cases.columns else F.col("readmission_30d")
    out = features.with_features(extract.with_record(cases))
    return out.select(F.col("case_id").alias("row_id"), F.coalesce("hospital_id", F.lit("UNKNOWN")).alias("site"), features.vector().alias("x"), label.cast("int").alias("y"))


def _guarded(step: Step, cases: DataFrame, column: str, empty: Column, what: str) -> DataFrame:
    """`step(cases)`; where it cannot be planned, or does not add the column, the column is null everywhere."""
    try:
        out = step(cases)
        out.schema[column]
        return out
    except Exception as e:  # noqa: BLE001  a broken step must neither leak a note nor end the run
        log.warning("%s failed: %s", what, e)
        return cases.withColumn(column, empty)


def redacted_where_unknown(rows: DataFrame, text: str = "note_text") -> DataFrame:
    """`rows` with pii_entities and deidentified_text; a note whose detection gave null is one PATIENT_NAME span as a whole.

    Where the detector gave text too, that stays; else the text is rendered from its spans.
    """
    t, found = F.coalesce(F.col(text), F.lit("")), F.col("pii_entities")
    span = F.struct(F.lit(0).alias("start"), F.length(t).alias("end"), F.lit("PATIENT_NAME").alias("label"))
    whole = F.when(t == "", F.array().cast(jsonl.SPANS)).otherwise(F.array(span).cast(jsonl.SPANS))
    spans = F.coalesce(found.cast(jsonl.SPANS), whole)
    given = F.when(found.isNotNull(), F.col("deidentified_text")) if "deidentified_text" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("deidentified_text", F.coalesce(given, render(t, spans))).withColumn("pii_entities", spans)


def predicted(cases: DataFrame, weights: np.ndarray | None, fallback: float, detect: Step = deid.with_pii, record: Step = extract.with_record) -> DataFrame:
    """case_id, pii_entities, deidentified_text, extracted_clinical_data, readmission_probability.

    One narrow pass: detection, extraction, features and model are columns of the same row. A missing note has no
    spans, empty text and the empty record; a probability that is no number becomes the fallback. `detect` adds
    pii_entities and `record` adds extracted_clinical_data: null spans redact the whole note, a null record is the
    empty one, and so for all notes where a step cannot be planned. Without weights all have the fallback.
    """
    rows = redacted_where_unknown(_guarded(detect, cases, "pii_entities", F.lit(None).cast(jsonl.SPANS), "de-identification"))
    rows = _guarded(record, rows, "extracted_clinical_data", F.lit(None).cast(extract.RECORD), "extraction")
    rows = rows.withColumn("extracted_clinical_data", F.coalesce("extracted_clinical_data", extract.empty_record()))
    rows = features.with_features(rows).withColumn("x", features.vector())
    weights = np.full(len(features.FEATURES) + 1, np.nan) if weights is None else weights
    rows = models.scored(rows, {(): weights}, fallback=fallback)
    return rows.select("case_id", "pii_entities", "deidentified_text", "extracted_clinical_data", F.col("p").alias("readmission_probability"))


def run(spark: SparkSession, train: str, inputs: str, out_dir: str, rounds: int = v.ROUNDS) -> dict:
    """Train the federated model, predict every input case, write predictions and two summaries."""
    labelled, bad_train = jsonl.read_tolerant(spark, train, jsonl.TRAIN)
    cases, bad_inputs = jsonl.read_tolerant(spark, inputs, jsonl.INPUT)
    rows = training_rows(labelled).cache()
    curve: list[tuple[int, np.ndarray]] = []
    weights = models.fedavg(rows, rounds=rounds, on_round=lambda r, w: curve.append((r, w[()])))[()]
    rate = rows.agg(F.avg("y")).first()[0] or 0.0
    jsonl.write_jsonl(predicted(cases, weights, rate), f"{out_dir}/predictions.jsonl")
    refused = {"train": bad_train.count(), "input": bad_inputs.count()}
    shown = [(r, w) for r, w in curve if r == 1 or r == 5 or r % 10 == 0]
    experiment = jsonl.write_json(str(Path(out_dir) / "experiment_summary.json"), lambda: experiment_summary(rows, shown, rounds) | {"refused_lines": refused})
    privacy = jsonl.write_json(str(Path(out_dir) / "privacy_summary.json"), lambda: privacy_summary(rows, steps=min(rounds, v.STEPS)))
    rows.unpersist()
    return {"experiment": experiment, "privacy": privacy, "refused_lines": refused}


NAMES = {"roc_auc": "auc", "average_precision": "average_precision", "brier_score": "brier", "log_loss": "log_loss"}


def model_metrics(rows: DataFrame, seeds: tuple[int, ...] = SUMMARY_SEEDS, k: int = 5, rounds: int = v.ROUNDS) -> dict[str, dict]:
    """For local, federated and centralised models: mean metrics over repeats of stratified folds, overall and by site."""
    folded = folds.stratified_folds(rows, k, seeds).persist()
    out = {}
    for kind in ("local", "federated", "centralized"):
        scored = folds.out_of_fold(folded, k, kind, **({"rounds": rounds} if kind == "federated" else {})).persist()
        mean = [F.avg(c).alias(name) for c, name in NAMES.items()]
        total = metrics.ranking_metrics(scored, ("seed",)).agg(*mean).first().asDict()
        sites = metrics.ranking_metrics(scored, ("seed", "site")).groupBy("site").agg(*mean).orderBy("site").collect()  # a row per site
        out[kind] = {"overall": total, "by_site": {r["site"]: {n: r[n] for n in NAMES.values()} for r in sites}}
        scored.unpersist()
    folded.unpersist()
    return out


def experiment_summary(rows: DataFrame, curve: list[tuple[int, np.ndarray]], rounds: int = v.ROUNDS) -> dict:
    """Settings, models with their cross-validated metrics, sites, communication and the log loss on the training rows after
    some rounds; all from small aggregates."""
    sites = {r["site"]: {"n": r["n"], "readmission_rate": r["rate"]} for r in rows.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate")).orderBy("site").collect()}
    spark = rows.sparkSession
    steps = spark.createDataFrame([(r, [float(t) for t in w]) for r, w in curve], "round int, w array<double>")
    losses = metrics.ranking_metrics(rows.join(F.broadcast(steps)).withColumn("p", models.predict(F.col("w"), F.col("x"))), ("round",))
    names = sorted(features.FEATURES)
    rates = [s["readmission_rate"] for s in sites.values() if s["readmission_rate"] is not None]
    return {
        "settings": {"C": v.C, "rounds": rounds, "local_updates": v.LOCAL_UPDATES, "seed": v.SEED},
        "random_seeds": {"start": v.SEED, "folds": list(SUMMARY_SEEDS)},
        "sites": sites,
        "local_models": {s: {"algorithm": "logistic regression, Newton steps", "feature_set": names, "training_rows": row["n"]} for s, row in sites.items()},
        "federated_model": {
            "algorithm": "federated averaging of logistic regressions", "rounds": rounds, "local_epochs": v.LOCAL_UPDATES,
            "optimizer": "full-batch gradient steps", "client_weighting": "rows of the site", "feature_set": names,
        },
        "centralized_model": {"algorithm": "logistic regression over all rows, for comparison only", "feature_set": names},
        "metrics": model_metrics(rows, rounds=rounds),
        "communication": models.communication(len(sites), len(features.FEATURES), v.ROUNDS) | {"what_leaves_each_client": "weights and a row count, no row of a patient"},
        "convergence": {"train_log_loss_by_round": {r["round"]: r["log_loss"] for r in losses.orderBy("round").collect()}},
        "non_iid_analysis": {"observations": [f"readmission rates of the sites range from {min(rates, default=0):.3f} to {max(rates, default=0):.3f}"]},
        "limitations": ["gradient steps in place of a quasi-Newton solver: the same optimum, other values on the way", "all sites run in one application"],
    }


def measured_privacy(rows: DataFrame, noise: float = v.SIGMA, steps: int = v.STEPS, seeds: tuple[int, ...] = SUMMARY_SEEDS, k: int = 5) -> dict[str, float]:
    """AUC, Brier score and seconds a training with and without noise and clipping, over repeats of plain folds."""
    folded = folds.plain_folds(rows, k, seeds).persist()
    folded.count()
    out = {}
    for name, options in (("private", {"noise": noise}), ("without_noise", {"noise": 0.0, "clip": 1e6})):
        began = time.perf_counter()
        scored = folds.out_of_fold(folded, k, "private", rounds=steps, **options)
        out[f"{name}_seconds"] = round((time.perf_counter() - began) / (k * len(seeds)), 4)  # all trainings share each round
        mean = metrics.ranking_metrics(scored, ("seed",)).agg(F.avg("roc_auc").alias("auc"), F.avg("brier_score").alias("brier")).first()
        out |= {f"{name}_auc": mean["auc"], f"{name}_brier": mean["brier"]}
    folded.unpersist()
    return out


def privacy_summary(rows: DataFrame, noise: float = v.SIGMA, steps: int = v.STEPS) -> dict:
    """The mechanism, its parameters and claim, and what it costs on these rows."""
    measured = measured_privacy(rows, noise, steps)
    return {
        "mechanism": "row gradients are clipped, summed inside a site, and noise is added to the sum before it leaves the site",
        "implementation_status": "the predictions come from the model without noise; the private model is measured beside it",
        "protected_asset": "the record of one patient, and whether it is among a site's rows",
        "adversary": "whoever sees the sites' messages or the final weights",
        "trust_assumptions": ["sites clip and add noise as told", "the seed of the noise is secret", "row counts of sites are public", "a patient belongs to one site"],
        "parameters": {
            "clip": v.CLIP, "noise_multiplier": noise, "rounds": steps, "learning_rate": v.LEARNING_RATE, "l2": v.L2, "delta": v.DELTA,
            "epsilon": models.epsilon(noise, steps), "epsilon_closed_form": models.epsilon_closed_form(noise, steps),
        },
        "privacy_claim": "holds for the released weights of the private model, per patient added or removed, if the seed of the noise is secret",
        "not_guaranteed": ["rates of whole sites", "spans and records, which are made from the notes themselves", "the model without noise"],
        "utility_analysis": {key: x for key, x in measured.items() if not key.endswith("seconds")},
        "runtime_analysis": {key: x for key, x in measured.items() if key.endswith("seconds")},
        "remaining_attack_surface": ["the server sees each site's own noisy sum", "few sites make their averages telling"],
        "limitations": ["the setting was chosen on the same rows"],
    }


def evaluated(inputs: DataFrame, truth: DataFrame, predictions: DataFrame) -> dict:
    """Scores of all three tasks and the overall score; missing predictions count as empty, extra ones as messages."""
    for name, df in (("input", inputs), ("truth", truth), ("predictions", predictions)):
        jsonl.require_key(df, name=name)
    lost = [r[0] for r in jsonl.missing_cases(truth, inputs).limit(5).collect()]
    if lost:
        raise jsonl.BadInput(f"input lacks {', '.join(lost)}")
    t = truth.select("case_id", F.col("pii_entities").alias("true_spans"), F.col("extracted_clinical_data").alias("truth"), F.col("readmission_30d").alias("y"))
    p = predictions.select("case_id", F.col("pii_entities").alias("pred_spans"), "deidentified_text", F.col("extracted_clinical_data").alias("prediction"), metrics.valid_probability(F.col("readmission_probability")).alias("p"), metrics.probability_message(F.col("readmission_probability")).alias("p_message"))
    site = F.coalesce("hospital_id", F.lit("UNKNOWN")).alias("site")
    joined = inputs.select("case_id", "note_text", site).join(t, "case_id").join(p, "case_id", "left").withColumn("p", F.coalesce("p", F.lit(0.5))).cache()
    spans = metrics.deid_scores(metrics.span_counts(joined)).first().asDict()
    fields = metrics.extraction_scores(joined).first().asDict()
    ranking = metrics.prediction_scores(joined).first().asDict()
    by_site = {r["site"]: r.asDict() for r in metrics.ranking_metrics(joined, ("site",)).collect()}
    wrong = joined.select("case_id", F.explode(F.concat(metrics.span_messages(F.col("pred_spans"), F.col("note_text")), F.filter(F.array("p_message"), lambda m: m.isNotNull()))).alias("m"))
    faults = [f"{r['case_id']}: {r['m']}" for r in wrong.orderBy("case_id", "m").limit(10).collect()]  # a report of ten
    notes = [f"missing prediction: {r[0]}" for r in jsonl.missing_cases(truth, predictions).orderBy("case_id").limit(10).collect()]
    notes += [f"extra prediction: {r[0]}" for r in jsonl.missing_cases(predictions, truth).orderBy("case_id").limit(10).collect()]
    notes += faults
    joined.unpersist()
    total = metrics.overall_score(spans["score"], fields["score"], ranking["score"])
    overall, points = total["overall"], total["points"]
    return {"deidentification": spans, "extraction": fields, "prediction": ranking | {"by_site": by_site}, "overall": overall, "points": points, "messages": notes}


def studied(rows: DataFrame, seeds: tuple[int, ...] = v.STUDY_SEEDS, k: int = 5, rounds: int = v.ROUNDS) -> DataFrame:
    """model and mean and sd of the metrics over repeated stratified folds; every round serves all seeds and folds."""
    folded = folds.stratified_folds(rows, k, seeds).cache()
    parts = [metrics.ranking_metrics(folds.out_of_fold(folded, k, kind, **({"rounds": rounds} if kind == "federated" else {})), ("seed",)).withColumn("model", F.lit(kind)) for kind in ("local", "federated", "centralized")]
    return metrics.mean_sd(parts[0].unionByName(parts[1]).unionByName(parts[2]), ("model",), ("roc_auc", "average_precision", "brier_score", "log_loss"))

"""python -m spanloom predict|evaluate|errors ...: thin drivers; bad input ends with status 2."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import deid, errors, extract, metrics
from .plans import submission
from .sources import jsonl


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="spanloom")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("predict")
    for name in ("train", "input", "out"):
        p.add_argument(f"--{name}", required=True)
    e = sub.add_parser("evaluate")
    for name in ("input", "truth", "predictions"):
        e.add_argument(f"--{name}", required=True)
    r = sub.add_parser("errors")
    r.add_argument("--split", choices=("train", "validation"), default="train")
    for name in ("train", "input", "truth", "case"):
        r.add_argument(f"--{name}", default="")
    r.add_argument("--limit", type=int, default=3)
    r.add_argument("--context", type=int, default=30)
    r.add_argument("--summary-only", action="store_true")
    a = top.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if a.command == "predict":
            print(json.dumps(submission.run(spark, a.train, a.input, a.out)["refused_lines"]))
        elif a.command == "evaluate":
            read = lambda path, schema: jsonl.read_strict(spark, path, schema)
            scores = submission.evaluated(read(a.input, jsonl.INPUT), read(a.truth, "case_id string, " + jsonl.TRUTH), read(a.predictions, jsonl.PREDICTION))
            print(json.dumps(scores, default=str, indent=2))
        else:
            cases = jsonl.load_split(spark, a.split, a.train, a.input, a.truth)
            if a.case and not (cases := cases.filter(F.col("case_id") == a.case)).take(1):
                raise jsonl.BadInput(f"unknown case {a.case}")
            report(cases, a.limit, a.context, a.summary_only)
    except jsonl.BadInput as error:
        print(error, file=sys.stderr)
        return 2
    return 0


def report(cases, limit: int, context: int, summary_only: bool) -> None:
    """Counts by kind, then rows, of span, list, number and category problems."""
    rows = extract.with_record(deid.with_pii(cases.withColumnsRenamed({"pii_entities": "true_spans", "extracted_clinical_data": "truth", "deidentified_text": "_"}).drop("_")), out="prediction")
    counts = metrics.span_counts(rows.withColumnRenamed("pii_entities", "pred_spans")).cache()
    spans, fields = metrics.deid_scores(counts).first(), metrics.extraction_scores(counts).first()
    print(f"de-identification score {spans['score']:.4f} (characters {spans['char_f1']:.4f}, entities {spans['entity_f1']:.4f})")
    print(f"structured extraction score {fields['score']:.4f} (diagnoses {fields['diagnoses_f1']:.4f}, medications {fields['medications_f1']:.4f})")
    parts = {"spans": (errors.span_problems(counts, context=context), ("kind", "label")), "numbers": (errors.numeric_problems(counts), ("field", "kind")), "categories": (errors.category_problems(counts), ("field",))}
    parts |= {f: (errors.list_problems(counts, f), ("kind", "value")) for f in ("diagnoses", "medications")}
    for name, (problems, keys) in parts.items():
        print(f"== {name}")
        errors.summary(problems, keys, limit).show(100, False)
        if not summary_only:
            problems.orderBy("case_id").show(limit, False)


if __name__ == "__main__":
    sys.exit(main())

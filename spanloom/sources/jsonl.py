"""JSON Lines, CSV and JSON in and out, key checks and the split loader."""

from __future__ import annotations

import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRUCTURED = "struct<age_years:int,sex:string,prior_admissions_12m:int,length_of_stay_days:int,emergency_admission:boolean>"
RECORD = "struct<diagnoses:array<string>,medications:array<string>,heart_rate_bpm:int,systolic_bp_mmhg:int,creatinine_mg_dl:double,hemoglobin_g_dl:double,lvef_percent:int,smoking_status:string,allergy:string>"
SPANS = "array<struct<start:int,end:int,label:string>>"
TRUTH = f"pii_entities {SPANS}, deidentified_text string, extracted_clinical_data {RECORD}, readmission_30d int"
INPUT = f"case_id string, hospital_id string, note_text string, structured_features {STRUCTURED}"
TRAIN = INPUT + f", labels struct<{', '.join(':'.join(p.split(' ', 1)) for p in (f'pii_entities {SPANS}', 'deidentified_text string', f'extracted_clinical_data {RECORD}', 'readmission_30d int'))}>"
PREDICTION = f"case_id string, pii_entities {SPANS}, deidentified_text string, extracted_clinical_data {RECORD}, readmission_probability double"


class BadInput(ValueError):
    """Input that a strict reader or a key check refuses."""


def read_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): blank lines are skipped, lines that are no JSON object of the schema are set aside with their text."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"}
    raw = spark.read.text(path).filter(F.trim("value") != "").select("value", F.from_json("value", schema + ", _line string", options).alias("r"))
    bad = F.col("r").isNull() | F.col("r._line").isNotNull()
    return raw.filter(~bad).select("r.*").drop("_line"), raw.filter(bad).select(F.col("value").alias("_line"))


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fails on the first bad line."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def require_key(df: DataFrame, key: str = "case_id", name: str = "input") -> DataFrame:
    """`df`, after a check that the key is a non-empty string and unique; one aggregation, a few rows come back."""
    if isinstance(df.schema[key].dataType, T.StringType) and df.filter(F.col(key).isNull() | (F.col(key) == "")).limit(1).count():
        raise BadInput(f"{name}: {key} is missing or empty")
    twice = [r[0] for r in df.groupBy(key).count().filter("count > 1").orderBy(key).limit(5).collect()]
    if twice:
        raise BadInput(f"{name}: {key} occurs more than once: {', '.join(map(str, twice))}")
    return df


def load_split(spark: SparkSession, split: str, train: str, inputs: str, truth: str) -> DataFrame:
    """Cases with their truth: inline labels for train, a joined file for validation."""
    if split == "train":
        rows = require_key(read_strict(spark, train, TRAIN), name="train")
        return rows.select("case_id", "hospital_id", "note_text", "structured_features", "labels.*")
    if split != "validation":
        raise BadInput(f"unknown split {split}")
    cases, answers = require_key(read_strict(spark, inputs, INPUT), name="input"), require_key(read_strict(spark, truth, "case_id string, " + TRUTH), name="truth")
    missing = [r[0] for r in missing_cases(answers, cases).limit(5).collect()]
    if missing:
        raise BadInput(f"input lacks {', '.join(missing)}")
    return cases.join(answers, "case_id")


def missing_cases(wanted: DataFrame, given: DataFrame, key: str = "case_id") -> DataFrame:
    """Keys of `wanted` that `given` lacks."""
    return wanted.select(key).join(given.select(key), key, "left_anti")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object per line, nulls written out; the order of lines carries no meaning."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """With header, doubles rounded."""
    rounded = [F.round(c, digits).alias(c) if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)) else F.col(c) for c in df.columns]
    df.select(*rounded).write.mode("overwrite").option("header", True).csv(path)


def write_json(path: str, build: Callable[[], dict]) -> dict:
    """A small summary from the driver; if it cannot be built the file says why."""
    try:
        content = build()
    except Exception as e:  # noqa: BLE001  the summary must not stop what it summarises
        content = {"error": str(e)}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(content, ensure_ascii=False, indent=2), encoding="utf-8")
    return content

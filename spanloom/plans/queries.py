"""Registered queries over the test tables, each over whole tables, with DuckDB statements that compute the same from columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vocabulary as v
from ..operators import deid, errors, extract, features, folds, metrics, models
from . import notes as nt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WITH = f"WITH {nt.TRUTH_SQL}"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def _record(spark: SparkSession, sf: str, fields: tuple[str, ...] = extract.FIELDS) -> DataFrame:
    return extract.with_record(nt.notes(spark, sf), fields=fields).withColumn("r", F.col("extracted_clinical_data"))


def _r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


# ------------------------------------------------------------------------------------------- de-identification


@query(WITH + """
SELECT label, count(*) AS n, sum(chars)::BIGINT AS chars FROM (
  SELECT unnest(['PATIENT_NAME', 'DATE_OF_BIRTH', 'ENCOUNTER_DATE', 'PHONE_NUMBER', 'PATIENT_ID', 'ADDRESS', 'CLINICIAN_NAME', 'CLINICIAN_NAME']) AS label,
         unnest([length(patient), 10, 10, 16, 8, length('Lindenweg ' || (1 + k % 200) || ', 10000 Berlin'), length(doctor), length(doctor)]) AS chars FROM truth
  UNION ALL SELECT 'EMAIL', length(doctor || '@clinic.example') FROM truth WHERE k % 3 = 0)
GROUP BY label""")
def pii_counts_by_label(spark: SparkSession, sf: str) -> DataFrame:
    spans = deid.with_pii(nt.notes(spark, sf)).select(F.explode_outer("pii_entities").alias("s")).filter("s is not null")  # an inner explode would infer a filter and run all detectors again
    return spans.groupBy("s.label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s.end") - F.col("s.start")).alias("chars"))


@query(WITH + """
SELECT k AS case_id, 'SYNTHETIC WARD RECORD' || chr(10) || 'Patient: [PATIENT_NAME] (DOB: [DATE_OF_BIRTH])' || chr(10)
  || 'MRN: [PATIENT_ID] | Encounter date: [ENCOUNTER_DATE]' || chr(10) || 'Phone: [PHONE_NUMBER]' || chr(10) || 'Address: [ADDRESS]' || chr(10)
  || 'Attending physician: Dr. [CLINICIAN_NAME]' || CASE WHEN k % 3 = 0 THEN chr(10) || 'Mail [EMAIL]' ELSE '' END AS head FROM truth""")
def render_redaction(spark: SparkSession, sf: str) -> DataFrame:
    out = deid.with_pii(nt.notes(spark, sf))
    return out.select("case_id", F.substring_index("deidentified_text", "\nDx:", 1).alias("head"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))::BIGINT AS n_emails FROM documents")
def email_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.size(deid.emails(F.coalesce("text", F.lit("")))).cast("long").alias("n_emails"))


@query("""SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g') AS redacted FROM documents""")
def redact_emails(spark: SparkSession, sf: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    found = _docs(spark, sf).select("doc_id", t.alias("text"), tx.resolve(deid.email_layer(t)).alias("s"))
    return found.select("doc_id", tx.render(F.col("text"), F.col("s")).alias("redacted"))


@query(WITH + "SELECT k AS case_id, lpad((1 + k % 28)::VARCHAR, 2, '0') || '.' || lpad((1 + k % 12)::VARCHAR, 2, '0') || '.' || (1930 + k % 70) AS birth, '2025-' || lpad((1 + c % 12)::VARCHAR, 2, '0') || '-' || lpad((1 + c % 28)::VARCHAR, 2, '0') AS encounter FROM truth")
def dates_by_context(spark: SparkSession, sf: str) -> DataFrame:
    df = nt.notes(spark, sf).select("case_id", "note_text", deid.date_layer(F.col("note_text")).alias("d"))
    of = lambda label: F.get(F.transform(F.filter("d", lambda x: x["label"] == label), lambda x: tx.piece(F.col("note_text"), x["start"], x["end"])), F.lit(0))
    return df.select("case_id", of("DATE_OF_BIRTH").alias("birth"), of("ENCOUNTER_DATE").alias("encounter"))


@query("""SELECT o_orderkey AS case_id, 1930 + o_orderkey % 30 AS birth_year, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT AS n_encounters FROM orders""")
def dates_inferred(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    y = (1930 + k % 30).cast("string")
    note = F.concat(F.lit("note of 2024-05-06, "), F.when(k % 2 == 1, "03/04/2023 and ").otherwise(""), F.lit("01.02."), y)
    df = spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("case_id"), note.alias("t")).select("case_id", "t", deid.date_layer(F.col("t")).alias("d"))
    birth = F.get(F.filter("d", lambda x: x["label"] == "DATE_OF_BIRTH"), F.lit(0))
    return df.select("case_id", tx.piece(F.col("t"), birth["end"] - 4, birth["end"]).cast("long").alias("birth_year"), F.size(F.filter("d", lambda x: x["label"] == "ENCOUNTER_DATE")).cast("long").alias("n_encounters"))


@query(WITH + "SELECT k AS case_id, doctor, CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS from_email, 2::BIGINT AS repeats FROM truth")
def clinician_names(spark: SparkSession, sf: str) -> DataFrame:
    df = nt.notes(spark, sf).withColumns({"cue": deid.clinician_cue_spans(F.col("note_text")), "mail": deid.emails(F.col("note_text"))})
    return df.select(
        "case_id", F.col("cue")[0]["text"].alias("doctor"), F.size(deid.email_name_spans(F.col("note_text"), F.col("mail"))).cast("long").alias("from_email"),
        F.size(deid.repeat_spans(F.col("note_text"), F.transform("cue", lambda s: s["text"]))).cast("long").alias("repeats"),
    )


@query("""
WITH c AS (SELECT doc_id, unnest(range(8)) AS j FROM documents),
s AS (SELECT doc_id, j, ((doc_id * 7 + j * 13) % 50) AS a, ((doc_id * 7 + j * 13) % 50) + 1 + (doc_id + j * 5) % 12 AS b, (doc_id + j) % 4 AS p FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY -p, a - b, a, j) AS i FROM s),
g AS (SELECT doc_id, list(struct_pack(a := a, b := b, p := p) ORDER BY i) AS l FROM r GROUP BY doc_id),
k AS (SELECT doc_id, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.a < x[1].b AND y.b > x[1].a)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM g)
SELECT doc_id, len(kept)::BIGINT AS n, list_sum(list_transform(kept, lambda x: x.b - x.a))::BIGINT AS chars, list_sum(list_transform(kept, lambda x: x.p))::BIGINT AS priorities FROM k""")
def resolve_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")

    def candidate(j: Column) -> Column:
        a = ((d * 7 + j * 13) % 50).cast("int")
        return F.struct(a.alias("start"), (a + 1 + (d + j * 5) % 12).cast("int").alias("end"), F.concat(F.lit("L"), j.cast("string")).alias("label"), ((d + j) % 4).cast("int").alias("priority"), F.lit("s").alias("source"))

    kept = _docs(spark, sf).select("doc_id", tx.resolve(F.transform(F.sequence(F.lit(0), F.lit(7)), candidate)).alias("s"))
    total = lambda f: F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + f(x))
    return kept.select("doc_id", F.size("s").cast("long").alias("n"), total(lambda x: x["end"] - x["start"]).alias("chars"), total(lambda x: x["priority"]).alias("priorities"))


@query(WITH + """SELECT label, count(*) AS n FROM (SELECT unnest(['DATE_OF_BIRTH', 'ENCOUNTER_DATE', 'PHONE_NUMBER']) AS label FROM truth UNION ALL SELECT 'EMAIL' FROM truth WHERE k % 3 = 0) GROUP BY label""")
def simple_pii_counts(spark: SparkSession, sf: str) -> DataFrame:
    spans = nt.notes(spark, sf).select(F.explode(deid.simple_pii(F.col("note_text"))).alias("s"))
    return spans.groupBy("s.label").agg(F.count(F.lit(1)).alias("n"))


def _orders(spark: SparkSession, sf: str) -> tuple[DataFrame, Column]:
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey"), F.col("o_orderkey")


def _found(rows: DataFrame, note: Column, layer: Callable[[Column], Column], label: str) -> DataFrame:
    """case_id and the texts that a layer finds under a label, joined by |."""
    t = F.col("note_text")
    rows = rows.select(F.col("o_orderkey").alias("case_id"), note.alias("note_text")).withColumn("s", F.filter(layer(t), lambda s: s["label"] == label))
    return rows.select("case_id", F.array_join(F.transform("s", lambda s: tx.piece(t, s["start"], s["end"])), "|").alias("found"))


def _name(k: Column) -> Column:
    return F.concat_ws(" ", nt._pick(nt.FIRST, k % 8), nt._pick(nt.LAST, F.floor(k / 8) % 8))


NAME_SQL = f"{nt._sql_list(nt.FIRST)}[o_orderkey % 8 + 1] || ' ' || {nt._sql_list(nt.LAST)}[(o_orderkey // 8) % 8 + 1]"


@query("SELECT o_orderkey AS case_id, '0131 496 ' || (1000 + o_orderkey % 9000) AS found FROM orders")
def phone_after_cue(spark: SparkSession, sf: str) -> DataFrame:
    rows, k = _orders(spark, sf)
    return _found(rows, F.concat(F.lit("Tel: 0131 496 "), (1000 + k % 9000).cast("string"), F.lit(". Room 12, 0131 496 0000 is not cued")), deid.phone_layer, "PHONE_NUMBER")


@query("SELECT o_orderkey AS case_id, 'XY/24/' || (10000 + o_orderkey % 90000) AS found FROM orders")
def identifier_by_shape(spark: SparkSession, sf: str) -> DataFrame:
    """Three parts; with four digits or more in the second, the form of two parts matches first and ends there."""
    rows, k = _orders(spark, sf)
    return _found(rows, F.concat(F.lit("Sample XY/24/"), (10000 + k % 90000).cast("string"), F.lit(" was kept")), deid.identifier_layer, "PATIENT_ID")


@query(f"SELECT o_orderkey AS case_id, {NAME_SQL} AS found FROM orders")
def patient_by_anchor(spark: SparkSession, sf: str) -> DataFrame:
    rows, k = _orders(spark, sf)
    after = F.when(k % 3 == 0, ", born 01.02.1950").when(k % 3 == 1, " (DOB 01.02.1950)").otherwise(" / AB-1234")
    return _found(rows, F.concat(F.lit("letter\n"), _name(k), after), deid.patient_layer, "PATIENT_NAME")


@query(f"SELECT o_orderkey AS case_id, {NAME_SQL} AS found FROM orders")
def patient_under_banner(spark: SparkSession, sf: str) -> DataFrame:
    rows, k = _orders(spark, sf)
    return _found(rows, F.concat(F.lit("WARD EXPORT LIST\n"), _name(k), F.lit(" then text")), deid.patient_layer, "PATIENT_NAME")


@query("SELECT o_orderkey AS case_id, 'Lindenweg ' || (1 + o_orderkey % 200) || ', ' || (10000 + o_orderkey % 80000) || ' Berlin' AS found FROM orders")
def address_by_shape(spark: SparkSession, sf: str) -> DataFrame:
    rows, k = _orders(spark, sf)
    return _found(rows, F.concat(F.lit("seen at Lindenweg "), (1 + k % 200).cast("string"), F.lit(", "), (10000 + k % 80000).cast("string"), F.lit(" Berlin by the ward")), deid.address_layer, "ADDRESS")


@query(f"SELECT o_orderkey AS case_id, {nt._sql_list(nt.DOCTOR_FIRST)}[o_orderkey % 5 + 1] || ' ' || {nt._sql_list(nt.DOCTOR_LAST)}[(o_orderkey // 5) % 7 + 1] AS found FROM orders")
def clinician_by_title(spark: SparkSession, sf: str) -> DataFrame:
    rows, k = _orders(spark, sf)
    doctor = F.concat_ws(" ", nt._pick(nt.DOCTOR_FIRST, k % 5), nt._pick(nt.DOCTOR_LAST, F.floor(k / 5) % 7))
    return _found(rows, F.concat(F.lit("yesterday Dr. "), doctor, F.lit(" came")), lambda t: tx.labelled(deid.clinician_title_spans(t), "CLINICIAN_NAME", v.PRIORITY["clinician title"], "title"), "CLINICIAN_NAME")


@query("SELECT doc_id, CASE WHEN length(x) > 220 THEN substr(x, 1, 217) || '...' ELSE x END AS shown FROM (SELECT doc_id, replace(text, chr(10), '\\n') AS x FROM documents)")
def flattened_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", tx.flattened(F.col("text")).alias("shown"))


# ------------------------------------------------------------------------------------------- extraction


@query(WITH + "SELECT k AS case_id, coalesce(diagnosis, '') AS diagnoses, medication AS medications FROM truth")
def lexicon_and_negation(spark: SparkSession, sf: str) -> DataFrame:
    return _record(spark, sf, ("diagnoses", "medications")).select("case_id", F.array_join("r.diagnoses", ",").alias("diagnoses"), F.array_join("r.medications", ",").alias("medications"))


@query(WITH + "SELECT k AS case_id, hr::INTEGER AS heart_rate_bpm, sbp::INTEGER AS systolic_bp_mmhg, creatinine AS creatinine_mg_dl, hb AS hemoglobin_g_dl, lvef::INTEGER AS lvef_percent FROM truth")
def numbers_and_units(spark: SparkSession, sf: str) -> DataFrame:
    return nt.notes(spark, sf).select("case_id", *[c.alias(k) for k, c in extract.numbers(F.col("note_text")).items()])


@query(WITH + "SELECT k AS case_id, smoking AS smoking_status, allergy FROM truth")
def smoking_and_allergy(spark: SparkSession, sf: str) -> DataFrame:
    return _record(spark, sf, ("smoking_status", "allergy")).select("case_id", "r.smoking_status", "r.allergy")


@query(WITH + "SELECT coalesce(diagnosis, 'nothing') AS diagnosis, site, count(*) AS n, round(avg(hb), 6) AS mean_hb FROM truth GROUP BY 1, 2")
def diagnoses_by_site(spark: SparkSession, sf: str) -> DataFrame:
    r = _record(spark, sf, ("diagnoses", "hemoglobin_g_dl")).select("hospital_id", F.explode_outer("r.diagnoses").alias("d"), "r.hemoglobin_g_dl")
    return r.groupBy(F.coalesce("d", F.lit("nothing")).alias("diagnosis"), F.col("hospital_id").alias("site")).agg(F.count(F.lit(1)).alias("n"), _r6(F.avg("hemoglobin_g_dl")).alias("mean_hb"))


SCOPED = (
    ("Mother had hypertension. ", ""), ("hypertension ruled out. ", ""), ("hypertension, stable. ", "hypertension"), ("hypertension unlikely. ", ""),
    ("Known hypertension. ", "hypertension"), ("Hypertension in his father. ", ""), ("hypertension, not copd. ", "hypertension"),
)
SCOPED_MEDICATIONS = (
    ("Aspirin was discontinued.", ""), ("Aspirin 100 mg daily.", "aspirin"), ("Intolerant to aspirin.", ""), ("Aspirin, later warfarin.", "aspirin,warfarin"), ("Lasix not tolerated; warfarin.", "warfarin"),
)


@query(f"SELECT o_orderkey AS case_id, {nt._sql_list(tuple(x for _, x in SCOPED))}[o_orderkey % {len(SCOPED)} + 1] AS diagnoses, {nt._sql_list(tuple(x for _, x in SCOPED_MEDICATIONS))}[o_orderkey % {len(SCOPED_MEDICATIONS)} + 1] AS medications FROM orders")
def family_and_post_cues(spark: SparkSession, sf: str) -> DataFrame:
    rows, k = _orders(spark, sf)
    note = F.concat(nt._pick(tuple(x for x, _ in SCOPED), k % len(SCOPED)), nt._pick(tuple(x for x, _ in SCOPED_MEDICATIONS), k % len(SCOPED_MEDICATIONS)))
    found = extract.with_record(rows.select(k.alias("case_id"), note.alias("note_text")), out="r", fields=("diagnoses", "medications"))
    return found.select("case_id", *[F.array_join(f"r.{f}", ",").alias(f) for f in ("diagnoses", "medications")])


@query("SELECT o_orderkey AS case_id, 0::BIGINT AS n_listed, 7::BIGINT AS n_null FROM orders")
def empty_records(spark: SparkSession, sf: str) -> DataFrame:
    """Null, empty and blank notes."""
    rows, k = _orders(spark, sf)
    found = extract.with_record(rows.select(k.alias("case_id"), F.when(k % 3 == 0, "").when(k % 3 == 1, " \n\t").alias("note_text")), out="r")
    nulls = sum((F.col(f"r.{f}").isNull().cast("long") for f in extract.FIELDS[2:]), F.lit(0).cast("long"))
    return found.select("case_id", (F.size("r.diagnoses") + F.size("r.medications")).cast("long").alias("n_listed"), nulls.alias("n_null"))


@query("SELECT smoking_status, count(*) AS n, count(*) FILTER (o_orderkey % 11 <> 0) AS with_lvef FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 'never' WHEN 1 THEN 'former' WHEN 2 THEN 'former' END AS smoking_status FROM orders) GROUP BY 1")
def simple_record_counts(spark: SparkSession, sf: str) -> DataFrame:
    r = nt.notes(spark, sf).select(extract.simple_record(F.col("note_text")).alias("r"))
    return r.groupBy("r.smoking_status").agg(F.count(F.lit(1)).alias("n"), F.count("r.lvef_percent").alias("with_lvef"))


# ------------------------------------------------------------------------------------------- features, models


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases with structured features and a record straight from the keys."""
    k = F.col("o_orderkey")
    record = F.struct(
        F.when(k % 3 == 0, F.array(F.lit("heart_failure"))).when(k % 3 == 1, F.array(F.lit("atrial_fibrillation"), F.lit("chronic_kidney_disease"))).otherwise(F.array().cast("array<string>")).alias("diagnoses"),
        F.slice(F.array(*[F.lit(m) for m in sorted(v.MEDICATIONS)]), F.lit(1), (k % 9).cast("int")).alias("medications"),
        F.when(k % 11 != 0, (20 + k % 60).cast("int")).alias("lvef_percent"), F.when(k % 13 != 0, (8.0 + k % 9).cast("double")).alias("hemoglobin_g_dl"),
    )
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    return orders.select(k.alias("row_id"), F.col("o_orderpriority").alias("site"), nt.structured(k).alias("structured_features"), record.alias("extracted_clinical_data"), (k % 3 == 0).cast("int").alias("y"))


FEATURES_SQL = """
f AS (SELECT o_orderkey AS k, o_orderpriority AS site, (o_orderkey % 3 = 0)::INTEGER AS y,
  greatest(-3.0, least(3.0, (o_orderkey % 90 - 60) / 15.0::DOUBLE)) AS age, (o_orderkey % 3 = 1)::INTEGER::DOUBLE AS atrial_fibrillation,
  (o_orderkey % 3 = 1)::INTEGER::DOUBLE AS chronic_kidney_disease, (o_orderkey % 3 = 0)::INTEGER::DOUBLE AS heart_failure,
  CASE WHEN o_orderkey % 13 = 0 THEN 0.0 ELSE greatest(-3.0, least(3.0, (8.0 + o_orderkey % 9 - 13) / 2.0::DOUBLE)) END AS hemoglobin,
  CASE WHEN o_orderkey % 11 = 0 THEN 0.0 ELSE greatest(-3.0, least(3.0, (20 + o_orderkey % 60 - 55) / 10.0::DOUBLE)) END AS lvef,
  (o_orderkey % 11 = 0)::INTEGER::DOUBLE AS lvef_missing, greatest(-3.0, least(3.0, (o_orderkey % 9 - 3) / 2.0::DOUBLE)) AS n_medications,
  least(o_orderkey % 8, 5) / 2.0::DOUBLE AS prior_admissions_12m FROM orders)"""


def _data(spark: SparkSession, sf: str) -> DataFrame:
    return features.with_features(_cases(spark, sf)).select("row_id", "site", features.vector().alias("x"), "y")


@query(f"WITH {FEATURES_SQL} SELECT k AS case_id, " + ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in features.FEATURES) + " FROM f")
def feature_vector(spark: SparkSession, sf: str) -> DataFrame:
    return features.with_features(_cases(spark, sf)).select(F.col("row_id").alias("case_id"), *[_r6(F.col(n)).alias(n) for n in features.FEATURES])


@query("SELECT coalesce(o_orderpriority, 'UNKNOWN') AS site, count(*) AS n, round(avg((o_orderkey % 3 = 0)::INTEGER), 6) AS rate FROM orders GROUP BY 1")
def site_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _cases(spark, sf).groupBy(F.coalesce("site", F.lit("UNKNOWN")).alias("site")).agg(F.count(F.lit(1)).alias("n"), _r6(F.avg("y")).alias("rate"))


def _weights_frame(spark: SparkSession, weights: dict[tuple, list]) -> DataFrame:
    names = [*sorted(features.FEATURES), "intercept"]
    return spark.createDataFrame([(*(str(x) for x in key), n, round(float(t), 6)) for key, w in weights.items() for n, t in zip(names, w)], "key string, feature string, weight double") if any(weights) else spark.createDataFrame(
        [(n, round(float(t), 6)) for w in weights.values() for n, t in zip(names, w)], "feature string, weight double"
    )


@query(f"WITH {FEATURES_SQL}, g AS (SELECT " + ", ".join(f"avg((0.5 - y) * {n}) AS {n}" for n in features.FEATURES) + ", avg(0.5 - y) AS intercept FROM f), u AS (UNPIVOT g ON COLUMNS(*) INTO NAME feature VALUE grad) SELECT feature, round(-4.0 * grad, 6) AS weight FROM u")
def fedavg_round1(spark: SparkSession, sf: str) -> DataFrame:
    return _weights_frame(spark, models.fedavg(_data(spark, sf), rounds=1, l2=0.0))


@query(
    f"WITH {FEATURES_SQL}, p AS (SELECT *, 1 / (1 + exp(-0.1 * (" + " + ".join(features.FEATURES) + " + 1.0))) - y AS e FROM f), "
    "g AS (SELECT site, count(*) AS n, " + ", ".join(f"avg(e * {n}) AS {n}" for n in features.FEATURES) + ", avg(e) AS intercept FROM p GROUP BY site), "
    "u AS (UNPIVOT g ON COLUMNS(* EXCLUDE (site, n)) INTO NAME feature VALUE grad) "
    "SELECT site AS key, feature, round(0.1 - 4.0 * (grad + CASE WHEN feature = 'intercept' THEN 0.0 ELSE 0.1 / (10.0 * n) END), 6) AS weight FROM u"
)
def fedavg_penalty_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """One round from equal weights for keys of unequal size: each has the penalty of its own number of rows."""
    data = _data(spark, sf).withColumn("k", F.col("site"))
    start = {k: np.full(len(features.FEATURES) + 1, 0.1) for k in models._keys_of(data, ["k"])}
    return _weights_frame(spark, models.fedavg(data, ("k",), rounds=1, start=start))


@query(f"WITH {FEATURES_SQL}, r AS (SELECT site, y, " + ", ".join(f"(0.5 - y) * {n} AS {n}" for n in features.FEATURES) + ", 0.5 - y AS intercept, sqrt(" + " + ".join(f"power((0.5 - y) * {n}, 2)" for n in features.FEATURES) + " + power(0.5 - y, 2)) AS len FROM f), g AS (SELECT site, " + ", ".join(f"sum({n} * least(1.0, 0.5 / greatest(len, 1e-12))) AS {n}" for n in (*features.FEATURES, "intercept")) + " FROM r GROUP BY site), u AS (UNPIVOT g ON COLUMNS(* EXCLUDE (site)) INTO NAME feature VALUE total) SELECT site, feature, round(total, 6) AS clipped_sum FROM u")
def clipped_gradient_sums(spark: SparkSession, sf: str) -> DataFrame:
    """What a site adds up before noise in the first private round."""
    g = F.transform("x", lambda t: (0.5 - F.col("y")) * t)
    rows = _data(spark, sf).select("site", models.clipped(g, v.CLIP).alias("g"))
    names = [*sorted(features.FEATURES), "intercept"]
    sums = rows.groupBy("site").agg(*[F.sum(F.col("g")[i]).alias(n) for i, n in enumerate(names)])
    return sums.unpivot("site", names, "feature", "clipped_sum").select("site", "feature", _r6(F.col("clipped_sum")).alias("clipped_sum"))


@query("SELECT round(sum(n * w) / sum(n), 6) AS weight, sum(n)::BIGINT AS n FROM (SELECT o_orderpriority, count(*) AS n, avg(o_orderkey % 17) AS w FROM orders GROUP BY 1)")
def weighted_average(spark: SparkSession, sf: str) -> DataFrame:
    sites = _cases(spark, sf).groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.array(F.avg(F.col("row_id") % 17)).alias("w"))
    return models.averaged(sites).select(_r6(F.col("w")[0]).alias("weight"), F.col("n").cast("long").alias("n"))


@query()
def centralized_fit(spark: SparkSession, sf: str) -> DataFrame:
    return _weights_frame(spark, models.newton_fit(_hard(spark, sf)))


@query()
def local_fits(spark: SparkSession, sf: str) -> DataFrame:
    return _weights_frame(spark, models.newton_fit(_hard(spark, sf), ("site",)))


def _slope(spark: SparkSession, sf: str, keys: tuple[str, ...]) -> DataFrame:
    """Gradient of the penalised loss, a row, at the weights that the fit returns."""
    data = _hard(spark, sf).withColumn("key", F.lit("all") if not keys else F.col(keys[0]))
    weights = models.newton_fit(data, ("key",))
    names = [*sorted(features.FEATURES), "intercept"]
    rows = models.scored(data, weights, ("key",)).withColumn("e", F.col("p") - F.col("y"))
    sums = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("e") * F.col("x")[i]).alias(n) for i, n in enumerate(names)])
    w = spark.createDataFrame([(k[0], n, 0.0 if n == "intercept" else float(t)) for k, ws in weights.items() for n, t in zip(names, ws)], "key string, feature string, w double")
    flat = sums.unpivot(["key", "n"], names, "feature", "g").join(F.broadcast(w), ["key", "feature"])  # a row per key and feature
    return flat.select("key", "feature", (F.round(F.abs(v.C * F.col("g") + F.col("w")) / F.col("n"), 6)).alias("slope"))


FEATURE_NAMES_SQL = f"(SELECT unnest({nt._sql_list((*sorted(features.FEATURES), 'intercept'))}) AS feature)"


@query(f"SELECT 'all' AS key, feature, 0.0::DOUBLE AS slope FROM {FEATURE_NAMES_SQL}")
def centralized_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """The fitted weights are the minimum: no feature has a slope left."""
    return _slope(spark, sf, ())


@query(f"SELECT key, feature, 0.0::DOUBLE AS slope FROM (SELECT DISTINCT o_orderpriority AS key FROM orders), {FEATURE_NAMES_SQL}")
def local_optimum(spark: SparkSession, sf: str) -> DataFrame:
    return _slope(spark, sf, ("site",))


@query()
def private_fedavg(spark: SparkSession, sf: str) -> DataFrame:
    return _weights_frame(spark, models.fedavg(_hard(spark, sf), rounds=3, clip=v.CLIP, noise=v.SIGMA, l2=v.L2))


def _hard(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that no feature gives away."""
    return _data(spark, sf).withColumn("y", (F.crc32(F.col("row_id").cast("string")) % 5 < 2).cast("int"))


ALPHA_SQL = "a AS (SELECT unnest(list_transform(range(900), lambda i: 1.01 + i * (10 - 1.01) / 899.0::DOUBLE) || list_transform(range(2460), lambda i: 10.1 + i * (256 - 10.1) / 2459.0::DOUBLE)) AS alpha)"


@query(f"WITH {ALPHA_SQL}, s AS (SELECT unnest([0.5, 1.0, 2.0, 4.0, 8.0])::DOUBLE AS sigma), t AS (SELECT unnest([20, 40, 50]) AS rounds) SELECT sigma, rounds::BIGINT AS rounds, round(min(rounds * alpha / (2 * sigma * sigma) + ln(1e5) / (alpha - 1)), 6) AS epsilon FROM a, s, t GROUP BY 1, 2")
def rdp_epsilon(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(float(s), t, round(models.epsilon(s, t), 6)) for s in (0.5, 1, 2, 4, 8) for t in (20, 40, 50)]
    return spark.createDataFrame(rows, "sigma double, rounds long, epsilon double")


# ------------------------------------------------------------------------------------------- metrics

LABELLED_SQL = "l AS (SELECT d.source AS site, l.quality AS y, (d.doc_id * 7919 % 1000) / 1000.0::DOUBLE AS p FROM labels l JOIN documents d USING (doc_id))"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    return labels.join(_docs(spark, sf).select("doc_id", "source"), "doc_id").select(F.col("source").alias("site"), F.col("quality").alias("y"), (F.col("doc_id") * 7919 % 1000 / F.lit(1000.0)).alias("p"))


RANKING_SQL = f"""
WITH {LABELLED_SQL}, k AS (SELECT 'all' AS site, y, p FROM l UNION ALL SELECT site, y, p FROM l),
r AS (SELECT *, rank() OVER (PARTITION BY site ORDER BY p) + (count(*) OVER (PARTITION BY site, p) - 1) / 2.0 AS rk FROM k),
b AS (SELECT site, count(*) AS n, avg(y) AS prevalence, sum(y) AS pos, count(*) - sum(y) AS neg, sum(CASE WHEN y = 1 THEN rk END) AS s, avg(power(p - y, 2)) AS brier,
      avg(-CASE WHEN y = 1 THEN ln(greatest(1e-7, least(1 - 1e-7, p))) ELSE ln(1 - greatest(1e-7, least(1 - 1e-7, p))) END) AS loss FROM r GROUP BY site),
t AS (SELECT site, p, sum(y) AS pos, count(*) AS c FROM k GROUP BY site, p),
q AS (SELECT site, pos, sum(pos) OVER w AS tp, sum(c) OVER w AS kk FROM t WINDOW w AS (PARTITION BY site ORDER BY p DESC ROWS UNBOUNDED PRECEDING)),
ap AS (SELECT site, sum(pos * tp / kk::DOUBLE) AS x FROM q GROUP BY site)
SELECT b.site, n, round(prevalence, 6) AS prevalence, CASE WHEN pos > 0 AND neg > 0 THEN round((s - pos * (pos + 1) / 2.0) / (pos * neg), 6) END AS roc_auc,
  CASE WHEN pos > 0 THEN round(x / pos, 6) ELSE 0 END AS average_precision, round(brier, 6) AS brier_score, round(loss, 6) AS log_loss FROM b JOIN ap USING (site)"""


@query(RANKING_SQL)
def ranking_by_site(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf)
    out = metrics.ranking_metrics(rows, ("site",)).unionByName(metrics.ranking_metrics(rows.withColumn("site", F.lit("all")), ("site",)))
    return out.select("site", "n", *[_r6(F.col(c)).alias(c) for c in ("prevalence", "roc_auc", "average_precision", "brier_score", "log_loss")])


@query(f"SELECT round(a.score, 4) AS score, round(w.worst, 4) AS worst_site_roc_auc FROM (SELECT 0.55 * coalesce(roc_auc, 0.5) + 0.25 * average_precision + 0.2 * (1 - brier_score) AS score FROM ({RANKING_SQL}) WHERE site = 'all') a, (SELECT min(roc_auc) AS worst FROM ({RANKING_SQL}) WHERE site <> 'all') w")
def prediction_composite(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.prediction_scores(_labelled(spark, sf)).select(*[F.round(c, 4).alias(c) for c in ("score", "worst_site_roc_auc")])


@query("""WITH t AS (SELECT avg((o_orderkey % 4 <> 0)::INTEGER) AS dx, sum((o_orderkey % 5 <> 0)::INTEGER) AS tp, sum((o_orderkey % 5 = 0)::INTEGER) AS fn, avg((o_orderkey % 2 = 0)::INTEGER) AS smoking,
  avg(CASE WHEN o_orderkey % 12 <= 3 THEN 1.0 ELSE greatest(0.0, 1.0 - (o_orderkey % 12 - 3) / 6.0::DOUBLE) END) AS hr FROM orders),
s AS (SELECT dx, 2.0 * tp / (2 * tp + fn) AS rx, (hr + 4) / 5 AS numbers, (smoking + 1) / 2 AS categories FROM t)
SELECT round(dx, 6) AS diagnoses_f1, round(rx, 6) AS medications_f1, round(numbers, 6) AS numeric_average, round(categories, 6) AS categorical_average,
  round(0.22 * dx + 0.22 * rx + 0.40 * numbers + 0.16 * categories, 6) AS score FROM s""")
def extraction_composite(spark: SparkSession, sf: str) -> DataFrame:
    rows, k = _orders(spark, sf)
    nothing = [F.lit(None).cast("double").alias(f) for f in v.TOLERANCE if f != "heart_rate_bpm"]
    record = lambda dx, rx, hr, smoking: F.struct(F.array(dx).alias("diagnoses"), rx.alias("medications"), hr.cast("double").alias("heart_rate_bpm"), *nothing, smoking.alias("smoking_status"), F.lit(None).cast("string").alias("allergy"))
    none, some = F.array().cast("array<string>"), F.array(F.lit("aspirin"))
    true = record(F.lit("copd"), some, F.lit(80), F.lit("never"))
    pred = record(F.when(k % 4 != 0, "COPD").otherwise("pneumonia"), F.when(k % 5 != 0, some).otherwise(none), 80 + k % 12, F.when(k % 2 == 0, "Never").otherwise("former"))
    one = metrics.extraction_scores(rows.select(true.alias("truth"), pred.alias("prediction")))
    return one.select(*[_r6(F.col(c)).alias(c) for c in ("diagnoses_f1", "medications_f1", "numeric_average", "categorical_average", "score")])


SPANS_SQL = """
s AS (SELECT doc_id, n_chars AS n, (doc_id * 13) % 40 AS a, 5 + doc_id % 7 AS len, doc_id % 8 AS lab FROM documents WHERE length(text) >= 60),
q AS (SELECT doc_id, a AS ta, a + len AS tb, lab AS tl, a + doc_id % 3 AS pa, a + len + doc_id % 2 AS pb, CASE WHEN doc_id % 5 = 0 THEN (lab + 1) % 8 ELSE lab END AS pl FROM s),
o AS (SELECT *, greatest(0, least(tb, pb) - greatest(ta, pa)) AS common FROM q)"""


def _span_cases(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    labels = F.array(*map(F.lit, v.LABELS))
    a, n = (d * 13 % 40).cast("int"), (5 + d % 7).cast("int")
    span = lambda s, e, lab: F.array(F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), F.get(labels, (lab % 8).cast("int")).alias("label")))
    rows = _docs(spark, sf).filter(F.length("text") >= 60)  # both spans must lie in the text
    return rows.select(d.alias("case_id"), F.col("text").alias("note_text"), span(a, a + n, d).alias("true_spans"), span(a + d % 3, a + n + d % 2, F.when(d % 5 == 0, d + 1).otherwise(d)).alias("pred_spans"))


@query(f"""WITH {SPANS_SQL}, t AS (SELECT sum(common) AS tp, sum(pb - pa - common) AS fp, sum(tb - ta - common) AS fn, sum(CASE WHEN tl = pl THEN common ELSE 0 END) AS ltp, sum(pb - pa) AS np, sum(tb - ta) AS nt,
  sum((ta = pa AND tb = pb AND tl = pl)::INTEGER) AS etp, count(*) AS n FROM o)
SELECT tp::BIGINT AS char_tp, fp::BIGINT AS char_fp, fn::BIGINT AS char_fn, round(2.0 * tp / (2 * tp + fp + fn), 6) AS char_f1, round(2.0 * ltp / (np + nt), 6) AS label_f1, round(etp / n::DOUBLE, 6) AS entity_f1, round(fn / (tp + fn)::DOUBLE, 6) AS leakage_rate FROM t""")
def span_scores(spark: SparkSession, sf: str) -> DataFrame:
    one = metrics.deid_scores(metrics.span_counts(_span_cases(spark, sf), rendered=None))
    return one.select(*[F.col(c).cast("long").alias(c) for c in ("char_tp", "char_fp", "char_fn")], *[_r6(F.col(c)).alias(c) for c in ("char_f1", "label_f1", "entity_f1", "leakage_rate")])


@query(f"""WITH {SPANS_SQL}, l AS (SELECT unnest(range(8)) AS j, unnest(['{"', '".join(v.LABELS)}']) AS label),
e AS (SELECT *, (ta = pa AND tb = pb AND tl = pl) AS hit FROM o)
SELECT label, (SELECT count(*) FROM e WHERE hit AND tl = j) AS tp, (SELECT count(*) FROM e WHERE NOT hit AND pl = j) AS fp, (SELECT count(*) FROM e WHERE NOT hit AND tl = j) AS fn FROM l""")
def entity_f1_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.entity_f1_by_label(metrics.span_counts(_span_cases(spark, sf), rendered=None)).select("label", "tp", "fp", "fn")


@query(f"WITH {SPANS_SQL} SELECT CASE WHEN ta = pa AND tb = pb THEN 'wrong label' WHEN common > 0 THEN 'boundary' ELSE 'leaked' END AS reason, count(*) AS n FROM o WHERE NOT (ta = pa AND tb = pb AND tl = pl) GROUP BY 1")
def miss_reasons(spark: SparkSession, sf: str) -> DataFrame:
    missed = errors.span_problems(metrics.span_counts(_span_cases(spark, sf), rendered=None)).filter("kind = 'missed'")
    return missed.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT doc_id, (doc_id % 11 = 0) AS tn, (doc_id % 7 = 0) AS pn, 60 + doc_id % 50 AS t, 60 + doc_id % 50 + doc_id % 13 AS p FROM documents)
SELECT round(avg(CASE WHEN tn AND pn THEN 1.0 WHEN tn OR pn THEN 0.0 WHEN p - t <= 3 THEN 1.0 ELSE greatest(0.0, 1.0 - (p - t - 3) / 6.0::DOUBLE) END), 6) AS score, round(avg(CASE WHEN NOT tn AND NOT pn THEN p - t END), 6) AS mae FROM s""")
def numeric_tolerance_score(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    t, p = F.when(d % 11 != 0, 60 + d % 50), F.when(d % 7 != 0, 60 + d % 50 + d % 13)
    rows = _docs(spark, sf).select(t.alias("t"), p.alias("p"))
    return rows.agg(_r6(F.avg(metrics.tolerance_score(F.col("t"), F.col("p"), 3.0))).alias("score"), _r6(F.avg(F.abs(F.col("p") - F.col("t")))).alias("mae"))


@query("""WITH s AS (SELECT list_distinct([doc_id % 3, doc_id % 4, doc_id % 5]) AS t, list_distinct([doc_id % 2, doc_id % 4]) AS p FROM documents),
c AS (SELECT sum(len(list_intersect(t, p))) AS tp, sum(len(p) - len(list_intersect(t, p))) AS fp, sum(len(t) - len(list_intersect(t, p))) AS fn FROM s)
SELECT tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def set_f1(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    # Spelled differently on purpose: both sides are normalised before they are compared.
    t = F.transform(F.array(d % 3, d % 4, d % 5), lambda x: F.concat(F.lit(" Item-"), x.cast("string")))
    p = F.transform(F.array(d % 2, d % 4), lambda x: F.concat(F.lit("item_"), x.cast("string")))
    cols = metrics.set_f1(F.col("t"), F.col("p"))
    return _docs(spark, sf).select(t.alias("t"), p.alias("p")).agg(*[cols[k].cast("long").alias(k) for k in ("tp", "fp", "fn")], _r6(cols["f1"]).alias("f1"))


@query(WITH + "SELECT 'smoking_status' AS field, coalesce(smoking, '__NULL__') AS expected, count(*) AS n FROM truth WHERE smoking IS DISTINCT FROM CASE WHEN k % 6 = 0 THEN 'never' ELSE smoking END GROUP BY 1, 2")
def category_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    smoking = F.when(k % 4 == 0, "never").when(k % 4 == 1, "former").when(k % 4 == 2, "current")
    pair = lambda s: F.struct(s.alias("smoking_status"), F.lit("none").alias("allergy"))
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("case_id"), pair(smoking).alias("truth"), pair(F.when(k % 6 == 0, " Never ").otherwise(smoking)).alias("prediction"))
    return errors.category_problems(rows).groupBy("field", "expected").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + """SELECT field, kind, count(*) AS n FROM (
  SELECT 'lvef_percent' AS field, CASE WHEN lvef IS NULL THEN 'invented' ELSE 'off' END AS kind FROM truth WHERE k % 11 = 0 OR (k % 10 = 3 AND k % 7 <> 0)
  UNION ALL SELECT 'lvef_percent', 'missing' FROM truth WHERE k % 11 <> 0 AND k % 7 = 0) GROUP BY 1, 2""")
def numeric_problem_kinds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    true = F.when(k % 11 == 0, F.lit(None)).when(k % 3 == 0, 25 + k % 50).otherwise(20 + k % 60).cast("double")
    pred = F.when(k % 11 == 0, 50.0).when(k % 7 == 0, F.lit(None)).when(k % 10 == 3, true + 4).otherwise(true)
    nothing = [F.lit(None).cast("double").alias(f) for f in v.TOLERANCE if f != "lvef_percent"]
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(k.alias("case_id"), F.struct(true.alias("lvef_percent"), *nothing).alias("truth"), F.struct(pred.cast("double").alias("lvef_percent"), *nothing).alias("prediction"))
    return errors.numeric_problems(rows).groupBy("field", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'missing' AS kind, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'extra', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def missing_extra_cases(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.jsonl import missing_cases

    docs, labels = _docs(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    count = lambda a, b, kind: missing_cases(a, b, "doc_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(docs, labels, "missing").unionByName(count(labels, docs, "extra"))


# ------------------------------------------------------------------------------------------- folds, selection


@query("SELECT o_orderpriority AS site, (o_orderkey % 3 = 0)::INTEGER AS y, 5::BIGINT AS folds, count(*) AS n, 1::BIGINT AS spread_at_most FROM orders GROUP BY 1, 2")
def stratified_fold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Every stratum is dealt over all folds, and no two folds differ by more than a row of it."""
    per = folds.stratified_folds(_cases(spark, sf), 5).groupBy("site", "y", "fold").agg(F.count(F.lit(1)).alias("c"))
    spread = F.max("c") - F.min("c")
    return per.groupBy("site", "y").agg(F.count(F.lit(1)).alias("folds"), F.sum("c").alias("n"), F.greatest(spread, F.lit(1)).cast("long").alias("spread_at_most"))


@query("SELECT 5::BIGINT AS folds, count(*) AS n, 1::BIGINT AS spread_at_most FROM orders")
def plain_fold_sizes(spark: SparkSession, sf: str) -> DataFrame:
    per = folds.plain_folds(_cases(spark, sf), 5).groupBy("fold").agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.count(F.lit(1)).alias("folds"), F.sum("c").alias("n"), F.greatest(F.max("c") - F.min("c"), F.lit(1)).cast("long").alias("spread_at_most"))


@query("""WITH g AS (SELECT s AS sigma, c AS clip, 0.75 - s / 100.0::DOUBLE - c / 1000.0::DOUBLE AS auc_mean, 0.02::DOUBLE AS auc_sd, CASE WHEN s > 0 THEN 10.0::DOUBLE / s ELSE 'infinity'::DOUBLE END AS epsilon
  FROM (SELECT unnest([0, 1, 2, 4, 8]) AS s), (SELECT unnest([1, 2]) AS c))
SELECT sigma::DOUBLE AS sigma, clip::DOUBLE AS clip, round(epsilon, 6) AS epsilon FROM g WHERE sigma > 0 AND auc_mean - auc_sd > 0.683 ORDER BY epsilon, auc_mean DESC LIMIT 1""")
def reference_setting(spark: SparkSession, sf: str) -> DataFrame:
    s, c = F.col("sigma"), F.col("clip")
    g = folds.grid(spark, sigma=(0, 1, 2, 4, 8), clip=(1, 2)).withColumns({"auc_mean": 0.75 - s / 100 - c / 1000, "auc_sd": F.lit(0.02), "epsilon": F.when(s > 0, F.lit(10.0) / s).otherwise(float("inf"))})
    return folds.reference_setting(g).select("sigma", "clip", _r6(F.col("epsilon")).alias("epsilon"))


@query("SELECT o_orderpriority AS held_out_site, (SELECT count(*) FROM orders) - count(*) AS n_train FROM orders GROUP BY 1")
def leave_one_site_out_counts(spark: SparkSession, sf: str) -> DataFrame:
    return folds.leave_one_site_out(_cases(spark, sf)).groupBy("held_out_site").agg(F.count(F.lit(1)).alias("n_train"))


@query("""WITH g AS (SELECT c, r, 0.45 + abs(c - 10) / 1000.0::DOUBLE + abs(r - 50) / 20000.0::DOUBLE AS loss FROM (SELECT unnest([1, 3, 10, 30, 100]) AS c), (SELECT unnest([20, 50, 100]) AS r))
SELECT c::DOUBLE AS c, r::DOUBLE AS rounds, round(loss, 6) AS loss FROM g WHERE loss <= (SELECT min(loss) FROM g) + 0.002 ORDER BY r, c LIMIT 1""")
def grid_select(spark: SparkSession, sf: str) -> DataFrame:
    g = folds.grid(spark, c=v.C_GRID, rounds=v.ROUND_GRID).withColumn("loss", 0.45 + F.abs(F.col("c") - 10) / 1000.0 + F.abs(F.col("rounds") - 50) / 20000.0)
    return folds.selected(g, "loss", 0.002, [F.col("rounds"), F.col("c")]).select("c", "rounds", _r6(F.col("loss")).alias("loss"))


@query()
def cross_site_transfer(spark: SparkSession, sf: str) -> DataFrame:
    rows = _hard(spark, sf)
    out = metrics.ranking_metrics(models.cross_site(rows, models.newton_fit(rows, ("site",))), ("model", "site"))
    return out.select("model", "site", "n", _r6(F.col("roc_auc")).alias("roc_auc"))


@query()
def cross_validated_central(spark: SparkSession, sf: str) -> DataFrame:
    folded = folds.stratified_folds(_hard(spark, sf), 5, (7, 19))
    return folds.cross_validated(folded, 5, ("centralized",)).select("model", "seed", "n", _r6(F.col("log_loss")).alias("log_loss"))

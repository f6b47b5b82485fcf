"""Clinical notes rendered from columns of the orders table, and the truth they hold.

The truth is arithmetic over the keys, in Spark here and in DuckDB in the queries' statements, which never look at
a text: an extraction rule that errs makes the two differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = ("Anna", "Bruno", "Clara", "David", "Elena", "Franz", "Greta", "Hugo")
LAST = ("Keller", "Scholz", "Lindner", "König", "Vogel", "Weiss", "Ziegler", "O'Donnell")
DOCTOR_FIRST = ("Emil", "Sarah", "Nadia", "Jonas", "Petra")
DOCTOR_LAST = ("Brandt", "Klein", "Haugen", "Reiter", "Sommer", "Fuchs", "Adler")
DIAGNOSIS_FORMS = (
    ("acute_coronary_syndrome", "acute coronary syndrome"), ("atrial_fibrillation", "AF"), ("chronic_kidney_disease", "CKD"), ("copd", "COAD"),
    ("coronary_artery_disease", "ischaemic heart disease"), ("heart_failure", "congestive heart failure"), ("hypertension", "HTN"),
    ("pneumonia", "bronchopneumonia"), ("type_2_diabetes", "type 2 diabetes"),
)
MEDICATION_FORMS = (
    ("amiodarone", "cordarone"), ("amlodipine", "amlodipine"), ("apixaban", "APX"), ("aspirin", "ecosprin"), ("atorvastatin", "lipitor"), ("azithromycin", "azithro"),
    ("bisoprolol", "concor"), ("clopidogrel", "plavix"), ("digoxin", "lanoxin"), ("furosemide", "lasix"), ("insulin", "lantus"), ("metformin", "metformin"),
    ("metoprolol", "beloc"), ("ramipril", "ramipril"), ("rivaroxaban", "xarelto"), ("warfarin", "phenprocoumon"),
)



def _pick(values: tuple[str, ...], i: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), i.cast("int"))


def _text(x: Column) -> Column:
    return x.cast("string")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id (long), hospital_id (one of five), note_text, k, c."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority")
    # A small file is one partition, and what follows is work per row: three narrow columns are dealt out first.
    orders = orders.repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    two = lambda x: F.lpad(_text(x), 2, "0")
    patient = F.concat_ws(" ", _pick(FIRST, k % 8), _pick(LAST, F.floor(k / 8) % 8))
    doctor_first, doctor_last = _pick(DOCTOR_FIRST, k % 5), _pick(DOCTOR_LAST, F.floor(k / 5) % 7)
    doctor = F.concat_ws(" ", doctor_first, doctor_last)
    diagnosis = lambda i: _pick(tuple(f for _, f in DIAGNOSIS_FORMS), i % 9)
    medication = lambda i: _pick(tuple(f for _, f in MEDICATION_FORMS), i % 16)
    hr, sbp = _text(50 + k % 100), _text(90 + k % 90)
    lines = [
        F.lit("SYNTHETIC WARD RECORD"),
        F.concat(F.lit("Patient: "), patient, F.lit(" (DOB: "), two(1 + k % 28), F.lit("."), two(1 + k % 12), F.lit("."), _text(1930 + k % 70), F.lit(")")),
        F.concat(F.lit("MRN: AB"), _text(100000 + k % 900000), F.lit(" | Encounter date: 2025-"), two(1 + c % 12), F.lit("-"), two(1 + c % 28)),
        F.concat(F.lit("Phone: +49 30 "), _text(1000 + k % 9000), F.lit(" "), _text(1000 + c % 9000)),
        F.concat(F.lit("Address: Lindenweg "), _text(1 + k % 200), F.lit(", "), _text(10000 + k % 80000), F.lit(" Berlin")),
        F.concat(F.lit("Attending physician: Dr. "), doctor),
        F.when(k % 3 == 0, F.concat(F.lit("Mail "), F.lower(doctor_first), F.lit("."), F.lower(doctor_last), F.lit("@clinic.example"))),
        F.concat(F.when(k % 5 == 0, "Dx: no evidence of ").otherwise("Dx: "), diagnosis(c), F.lit("; denies "), diagnosis(c + 4), F.lit(". Mother had "), diagnosis(c + 7), F.lit(".")),
        F.concat(F.lit("Medications: "), medication(k), F.lit(" 5 mg; "), medication(k + 5), F.lit(" stopped.")),
        F.concat(F.when(k % 7 == 0, "HR 300, repeat ").otherwise(""), F.lit("HR "), hr, F.lit(" bpm")),
        F.when(k % 4 == 1, F.concat(F.lit("systolic BP "), sbp)).otherwise(F.concat(F.lit("BP "), sbp, F.lit("/70 mmHg"))),
        F.when(k % 2 == 0, F.concat(F.lit("creatinine "), _text(60 + k % 300), F.lit(" umol/L"))).otherwise(
            F.concat(F.lit("creatinine "), _text(1 + k % 4), F.when(k % 3 == 0, ",").otherwise("."), _text(k % 10), F.lit(" mg/dL"))
        ),
        F.when(k % 2 == 1, F.concat(F.lit("Hb "), _text(80 + k % 90), F.lit(" g/L"))).otherwise(F.concat(F.lit("Hb "), _text(8 + k % 9), F.lit("."), _text(k % 10), F.lit(" g/dL"))),
        F.when(k % 11 == 0, "EF not documented").when(k % 3 == 0, F.concat(F.lit("LVEF "), _text(20 + k % 50), F.lit("-"), _text(30 + k % 50), F.lit("%"))).otherwise(F.concat(F.lit("LVEF "), _text(20 + k % 60), F.lit("%"))),
        F.when(k % 4 == 0, "Never smoked.").when(k % 4 == 1, "Former smoker.").when(k % 4 == 2, "Father is an ex-smoker. Actively smokes."),
        F.when(k % 5 == 0, "NKDA.").when(k % 5 == 1, "Allergy: penicillin.").when(k % 5 == 2, "Reaction to ibuprofen.").when(k % 5 == 3, "CT with contrast."),
        F.concat(F.lit("Signed: Dr. "), doctor),
    ]
    return orders.select(k.cast("long").alias("case_id"), F.col("o_orderpriority").alias("hospital_id"), F.concat_ws("\n", *lines).alias("note_text"), k.alias("k"), c.alias("c"))


def structured(k: Column) -> Column:
    """structured_features of a case."""
    return F.struct(
        (k % 90).cast("int").alias("age_years"), F.when(k % 2 == 0, "female").otherwise("male").alias("sex"), (k % 8).cast("int").alias("prior_admissions_12m"),
        (k % 20).cast("int").alias("length_of_stay_days"), (k % 3 == 0).alias("emergency_admission"),
    )


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


#: The same truth for DuckDB, one row per order: k, c, site and every field.
TRUTH_SQL = f"""
truth AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS site,
    {_sql_list(FIRST)}[o_orderkey % 8 + 1] || ' ' || {_sql_list(LAST)}[(o_orderkey // 8) % 8 + 1] AS patient,
    {_sql_list(DOCTOR_FIRST)}[o_orderkey % 5 + 1] || ' ' || {_sql_list(DOCTOR_LAST)}[(o_orderkey // 5) % 7 + 1] AS doctor,
    CASE WHEN o_orderkey % 5 <> 0 THEN {_sql_list(tuple(a for a, _ in DIAGNOSIS_FORMS))}[o_custkey % 9 + 1] END AS diagnosis,
    {_sql_list(tuple(a for a, _ in MEDICATION_FORMS))}[o_orderkey % 16 + 1] AS medication,
    50 + o_orderkey % 100 AS hr, 90 + o_orderkey % 90 AS sbp,
    CASE WHEN o_orderkey % 2 = 0 THEN round((60 + o_orderkey % 300) / 88.4::DOUBLE, 2) ELSE round((1 + o_orderkey % 4) + (o_orderkey % 10) / 10.0::DOUBLE, 2) END AS creatinine,
    CASE WHEN o_orderkey % 2 = 1 THEN round((80 + o_orderkey % 90) / 10.0::DOUBLE, 2) ELSE round((8 + o_orderkey % 9) + (o_orderkey % 10) / 10.0::DOUBLE, 2) END AS hb,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 25 + o_orderkey % 50 ELSE 20 + o_orderkey % 60 END AS lvef,
    CASE o_orderkey % 4 WHEN 0 THEN 'never' WHEN 1 THEN 'former' WHEN 2 THEN 'current' END AS smoking,
    CASE o_orderkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'penicillin' WHEN 2 THEN 'nsaid' END AS allergy
  FROM orders)"""

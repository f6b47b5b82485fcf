import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import errors, extract, metrics
from spanloom.plans import submission
from spanloom.sources import jsonl
from spanloom.streaming import structured

RECORD = {"diagnoses": ["hypertension"], "medications": ["aspirin"], "heart_rate_bpm": 80, "systolic_bp_mmhg": None, "creatinine_mg_dl": None, "hemoglobin_g_dl": None, "lvef_percent": None, "smoking_status": "never", "allergy": None}


def case(i, **more):
    return {"case_id": f"X{i}", "hospital_id": "BERLIN_NODE" if i % 2 else "CHENNAI_NODE", "note_text": "Patient: Anna Keller\nDx: HTN. HR 80. Never smoked.", "structured_features": {"age_years": 50 + i, "prior_admissions_12m": i % 4}} | more


def truth(i):
    return {"case_id": f"X{i}", "pii_entities": [{"start": 9, "end": 20, "label": "PATIENT_NAME"}], "deidentified_text": "", "extracted_clinical_data": RECORD, "readmission_30d": int(i == 1)}


def lines(path, rows):
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
    return str(path)


def test_run_and_evaluate(spark, tmp_path):
    train = lines(tmp_path / "train.jsonl", [case(i, labels={"readmission_30d": int(i % 3 == 0)}) for i in range(12)])
    inputs = lines(tmp_path / "in.jsonl", [case(1), "not json", "", case(2, note_text=None)])
    out = submission.run(spark, train, inputs, str(tmp_path / "out"), rounds=3)
    assert out["refused_lines"] == {"train": 0, "input": 1}
    got = {r.case_id: r for r in spark.read.schema(jsonl.PREDICTION).json(str(tmp_path / "out/predictions.jsonl")).collect()}
    assert got["X1"].deidentified_text.startswith("Patient: [PATIENT_NAME]") and got["X2"].pii_entities == [] and 0 <= got["X2"].readmission_probability <= 1
    raw = [json.loads(x) for p in (tmp_path / "out/predictions.jsonl").glob("part-*") for x in p.read_text().splitlines()]
    assert all("allergy" in r["extracted_clinical_data"] for r in raw)
    assert {k: x for k, x in out["experiment"]["communication"].items() if k.startswith("bytes")} == {"bytes_per_round": 320, "bytes_total": 16000}
    sites = {"BERLIN_NODE", "CHENNAI_NODE"}
    for model in ("local", "federated", "centralized"):
        m = out["experiment"]["metrics"][model]
        assert {"auc", "brier"} <= set(m["overall"]) and set(m["by_site"]) == sites
    assert set(out["experiment"]["local_models"]) == sites and out["experiment"]["convergence"]["train_log_loss_by_round"]
    assert {"private_auc", "without_noise_auc"} <= set(out["privacy"]["utility_analysis"]) and out["privacy"]["parameters"]["epsilon"] > 0
    assert {"mechanism", "adversary", "privacy_claim", "not_guaranteed", "runtime_analysis", "limitations"} <= set(out["privacy"])


def test_perfect_predictions_score_one(spark, tmp_path):
    inputs = spark.read.schema(jsonl.INPUT).json(lines(tmp_path / "i.jsonl", [case(1), case(2)]))
    answers = spark.read.schema("case_id string, " + jsonl.TRUTH).json(lines(tmp_path / "t.jsonl", [truth(1), truth(2)]))
    rows = [{k: x for k, x in truth(i).items() if k != "readmission_30d"} | {"deidentified_text": case(i)["note_text"].replace("Anna Keller", "[PATIENT_NAME]"), "readmission_probability": float(i == 1)} for i in (1, 2)]
    predictions = spark.read.schema(jsonl.PREDICTION).json(lines(tmp_path / "p.jsonl", rows))
    scores = submission.evaluated(inputs, answers, predictions)
    assert scores["extraction"]["score"] == pytest.approx(1.0) and scores["prediction"]["score"] == pytest.approx(1.0)
    assert scores["deidentification"]["char_f1"] == 1.0 and scores["deidentification"]["macro_f1"] == pytest.approx(1 / 8)
    some = submission.evaluated(inputs, answers, predictions.filter("case_id = 'X1'"))
    assert some["messages"] == ["missing prediction: X2"]
    with pytest.raises(jsonl.BadInput):
        submission.evaluated(inputs.union(inputs), answers, predictions)


def test_broken_steps_fall_back(spark, tmp_path):
    cases = spark.read.schema(jsonl.INPUT).json(lines(tmp_path / "i.jsonl", [case(1), case(2, note_text="")]))

    def broken(df):
        raise RuntimeError("boom")

    def unsure(df):  # no spans for one of the notes
        return df.withColumn("pii_entities", F.when(F.col("case_id") != "X1", F.array().cast(jsonl.SPANS)))

    for detect in (broken, unsure, lambda df: df):
        got = {r.case_id: r for r in submission.predicted(cases, None, 0.34, detect=detect, record=broken).collect()}
        assert got["X1"].deidentified_text == "[PATIENT_NAME]" and len(got["X1"].pii_entities) == 1 and got["X2"].deidentified_text == "" and got["X2"].pii_entities == []
        assert got["X1"].readmission_probability == 0.34 and got["X1"].extracted_clinical_data.diagnoses == [] and got["X1"].extracted_clinical_data.lvef_percent is None


def test_messages_tell_what_is_left_out(spark):
    spans = [(0, 3, "EMAIL"), (1, 4, "EMAIL"), (5, 99, "EMAIL"), (4, 6, "NOBODY"), (None, 2, "EMAIL"), None]
    df = spark.createDataFrame([("abcdefghij", spans, 1.5), ("abc", None, 0.5)], f"t string, s {jsonl.SPANS}, p double")
    a, b = df.select(metrics.span_messages(F.col("s"), F.col("t")).alias("m"), metrics.probability_message(F.col("p")).alias("p")).collect()
    assert len(a.m) == 5 and sum("outside" in m for m in a.m) == 1 and "NOBODY" in " ".join(a.m) and "overlaps" in a.m[-1] and a.p
    assert b.m == [] and b.p is None


def test_evidence_falls_back_to_the_section(spark):
    notes = [("Dx: pneumonia.\nRx: azithromycin.", "pneumonia"), ("Problem list: HTN; CKD.\nObs: HR 70 bpm.", "hypertension"), ("Known diagnoses: ischemic heart disease.", "chronic_kidney_disease"), ("A line that comes to its diagnoses only here.", "copd")]
    df = spark.createDataFrame(notes, "t string, c string").select(errors.evidence(F.col("t"), F.col("c"), field="diagnoses").alias("e"))
    assert [r.e for r in df.collect()] == [["pneumonia."], ["(section) Problem list: HTN; CKD."], ["(section) Known diagnoses: ischemic heart disease."], ["(section) A line that comes to its diagnoses only here."]]


def test_fields_asked_for(spark):
    df = spark.createDataFrame([("Known HTN. HR 80. Never smoked. NKDA.",)], "note_text string")
    some = extract.with_record(df, out="r", fields=("allergy", "heart_rate_bpm"))
    assert some.select("r.*").first().asDict() == {"allergy": "none", "heart_rate_bpm": 80} and "warfarin" not in some._jdf.queryExecution().toString()
    assert extract.with_record(df, out="r").schema["r"].dataType.simpleString() == extract.RECORD


def test_readers(spark, tmp_path):
    p = lines(tmp_path / "x.jsonl", [case(1), "not json", "", case(2)])
    good, bad = jsonl.read_tolerant(spark, p, jsonl.INPUT)
    assert (good.count(), bad.count()) == (2, 1)
    with pytest.raises(Exception, match="(?i)malformed|failfast|FAILED_READ"):
        jsonl.read_strict(spark, p, jsonl.INPUT).collect()
    jsonl.write_csv(spark.createDataFrame([(1, 0.123456)], "a int, b double"), str(tmp_path / "c"))
    assert "0.1235" in "".join(f.read_text() for f in (tmp_path / "c").glob("part-*.csv"))
    assert jsonl.write_json(str(tmp_path / "j.json"), lambda: 1 / 0)["error"]


def test_error_reports(spark):
    t, p = [(8, 19, "CLINICIAN_NAME"), (23, 33, "DATE_OF_BIRTH")], [(8, 19, "PATIENT_NAME"), (24, 33, "DATE_OF_BIRTH")]
    df = spark.createDataFrame([("a", "Signed: Emil Brandt on 01.02.1970", t, p)], f"case_id string, note_text string, true_spans {jsonl.SPANS}, pred_spans {jsonl.SPANS}")
    rows = errors.span_problems(metrics.span_counts(df, rendered=None)).collect()
    assert sorted((r.kind, r.reason) for r in rows if r.kind == "missed") == [("missed", "boundary"), ("missed", "wrong label")] and len(rows) == 4
    assert errors.summary(errors.span_problems(metrics.span_counts(df, rendered=None)), ("kind",)).first().n == 2
    e = spark.createDataFrame([("Known heart failure. HF stable.\nOther line",)], "t string").select(errors.evidence(F.col("t"), F.lit("heart_failure")).alias("e")).first().e
    assert e == ["Known heart failure."]


def test_stream(spark, tmp_path):
    lines(tmp_path / "a.json", [case(1), case(2)])
    stream = structured(spark.readStream.schema(jsonl.INPUT).json(str(tmp_path)))
    q = stream.writeStream.format("memory").queryName("notes_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("notes_out").filter("deidentified_text like '%[PATIENT_NAME]%'").count() == 2

import json

import numpy as np
import pytest

from spanloom.__main__ import main
from spanloom.operators import trees
from spanloom.plans import study


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = np.hstack([rng.normal(size=(90, 2)), np.ones((90, 1))])
    y = (rng.random(90) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(int)
    return spark.createDataFrame([(i, "abc"[i % 3], [float(t) for t in x[i]], int(y[i])) for i in range(90)], "row_id long, site string, x array<double>, y int").coalesce(2).cache()


def test_settings_and_sites(rows):
    g = study.settings_grid(rows, (1, 10), (2, 4), (1,), 3).cache()
    assert g.count() == 4 and study.chosen_settings(g).count() == 1
    assert study.leave_one_site_out(rows, rounds=2).count() == 3
    assert study.start_stability(rows, (1,), rounds=2).first().max_abs_difference > 0


def test_privacy_sweep(rows):
    s = study.privacy_sweep(rows, (0.5,), (0, 8), (2,), (1, 2), 3).collect()
    assert len(s) == 2 and s[0].epsilon == float("inf") and s[1].epsilon > 0


def test_trees_and_weights(rows):
    assert trees.federated_forest(rows, rows, 3).filter("p between 0 and 1").count() == 90
    assert trees.random_forest(rows, rows, 3).columns == [*rows.columns, "p"]
    w = trees.balanced_weights(rows).groupBy("y").agg({"weight": "sum"}).collect()
    assert w[0][1] == pytest.approx(w[1][1])


def test_command_line(spark, tmp_path, capsys):
    p = tmp_path / "t.jsonl"
    record = {"diagnoses": ["copd"], "medications": [], "smoking_status": None, "allergy": None}
    p.write_text(json.dumps({"case_id": "a", "hospital_id": "b", "note_text": "HTN", "labels": {"pii_entities": [], "deidentified_text": "HTN", "extracted_clinical_data": record, "readmission_30d": 0}}))
    assert main(["errors", "--train", str(p), "--summary-only"], spark) == 0
    shown = capsys.readouterr().out
    assert "copd" in shown and "de-identification score" in shown and "structured extraction score" in shown
    assert main(["errors", "--train", str(p), "--case", "zzz"], spark) == 2

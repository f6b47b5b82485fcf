import random
import re

from pyspark.sql import functions as F

from spanloom.functions import text as tx
from spanloom.functions import vocabulary as v


def test_find_agrees_with_python_on_random_strings(spark):
    random.seed(1)
    rows = [("".join(random.choices("ab1 é😀\n-", k=random.randint(0, 30))),) for _ in range(300)] + [("",)]
    df = spark.createDataFrame(rows, "t string")
    for pattern in ("[ab]+1?", "😀+", "a|b1", r"\n"):
        got = df.select("t", tx.find(F.col("t"), pattern).alias("s")).collect()
        for r in got:
            assert [(s.start, s.end, s.text) for s in r.s] == [(*m.span(), m.group()) for m in re.finditer(pattern, r.t)]
    got = df.select("t", tx.find(F.col("t"), "(a)([1 ]+)", group=2).alias("s")).collect()
    for r in got:
        assert [(s.start, s.end) for s in r.s] == [m.span(2) for m in re.finditer("(a)([1 ]+)", r.t)]


def test_resolution_against_a_plain_loop(spark):
    random.seed(2)
    rows = []
    for i in range(200):
        rows.append((i, [(s := random.randint(0, 20), s + random.randint(0, 6), random.choice("AB"), random.randint(0, 3), "x") for _ in range(random.randint(0, 9))]))
    df = spark.createDataFrame(rows, f"i int, c {tx.CANDIDATE}")
    for r in df.select("c", tx.resolve(F.col("c")).alias("k")).collect():
        kept = []
        for c in sorted(r.c, key=lambda c: (-c.priority, c.start - c.end, c.start, c.label)):
            if c.end > c.start and not any(c.start < o.end and c.end > o.start for o in kept):
                kept.append(c)
        assert [(c.start, c.end, c.label) for c in r.k] == [(c.start, c.end, c.label) for c in sorted(kept, key=lambda c: c.start)]


def test_render_trim_and_snippets(spark):
    df = spark.createDataFrame([("Hi Anna 😀 Bell!",)], "t string")
    spans = F.expr("array(named_struct('start', 3, 'end', 7, 'label', 'X'), named_struct('start', 10, 'end', 14, 'label', 'Y'))")
    r = df.select(tx.render(F.col("t"), spans).alias("r"), tx.snippet(F.col("t"), F.lit(3), F.lit(7), 3).alias("s")).first()
    assert (r.r, r.s) == ("Hi [X] 😀 [Y]!", "Hi «Anna» 😀 ")
    t = spark.range(1).select(tx.trimmed(F.struct(F.lit(5).alias("start"), F.lit(13).alias("end"), F.lit("  ab c.; ").alias("text"))).alias("t")).first().t
    assert t.text == "ab c" and t.end - t.start == 4


def test_guards_change_no_match(spark):
    """With and without the guard each pattern matches the same, in texts of its own words, odd letters and marks."""
    rng = random.Random(5)
    words = "HR hr 80 bpm BP 120/80 mmHg Dr. Emil Brandt Mrs. Phone: +49 30 1234 5678 MRN: AB123456 12.03.1950 2025-01-02 3 Mar 2024 ex-smoker non smoker \u017fmoker Smo\u212aer never smoked still smokes current smoker Tobacco no tobacco nichtraucher NKDA allergy: none IBUPROFEN contrast a.b@c.de %x@y.org \u00d6zil \u00c4nne O'Neil Address: Lindenweg 5, 10115 Berlin Flat 3, abcde, Delhi 110001 mother FHx denies but ruled out ? ; | . ! creatinine 1,2 mg/dl Hb 9 g/l LVEF 30-40% EF \u0663\u0664 _x pneumonia bronchopneumonia hypertension pulmonary hypertension DM II T2DM \u0130d \u0131p \x01 \x02 \U0001f600 seen by attending signed".split(" ")
    texts = ["".join(w + rng.choice(["", " ", " ", "\n", "-", "_", "."]) for w in rng.choices(words, k=40)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").cache()
    folded = [p for _, p in (*v.SMOKING, *v.ALLERGY)] + [v.HEART_RATE, v.BLOOD_PRESSURE, v.SYSTOLIC, v.CREATININE, v.HEMOGLOBIN, v.LVEF, v.FOREIGN_IN_GAP, v.ADDRESS_CUE, v.ALLERGY_CONTEXT, "(?:mother|FHx)", r"\b(?:but|id|kg)\b|\?"]
    folded += [f for table in (v.DIAGNOSES, v.MEDICATIONS) for fs, _ in table.values() for f in fs]
    exact = [v.EMAIL, v.PHONE_INTERNATIONAL, v.DATE, v.ID_SHAPE, *v.ADDRESS_SHAPES, v.NAME, v.CLAUSE_END, v.SENTENCE_END, v.PATIENT_CUE, v.TITLE, rf"((?i:\b(?:signed|seen by)\b\s*))({v.NAME})", r"x?", r"^|b"]
    for fold, patterns in ((True, folded), (False, exact)):
        flags = "(?Ui)" if fold else "(?U)"
        same = [(F.regexp_extract_all("t", F.lit(flags + p), F.lit(0)) == F.regexp_extract_all("t", F.lit(tx.rx(p, fold)), F.lit(0))).alias(f"p{i}") for i, p in enumerate(patterns)]
        for r in df.select(same).collect():
            assert all(r), [patterns[i] for i, ok in enumerate(r) if not ok]
    assert any("(?=" in tx.guarded(p, True) for p in folded)


def test_find_runs_its_regex_once(spark):
    df = spark.createDataFrame([("a\x01b12 c3",), ("\x01",), ("",), (None,), ("\U0001f600 9",)], "t string")
    for group, pattern in ((None, r"\d+"), (2, r"([a-z])(\d+)")):
        found = df.select(tx.find(F.col("t"), pattern, group=group).alias("s"))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") == 1 and "regexp_extract_all(" not in plan and "RLIKE" not in plan
        got = [[(s["start"], s["end"], s["text"]) for s in r["s"]] for r in found.collect()]
        assert got == [[(3, 5, "12"), (7, 8, "3")], [], [], [], [(2, 3, "9")] if group is None else []]

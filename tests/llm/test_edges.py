"""Every operator and stage over nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import bpe, decontaminate, exact_dedup, license_scan, line_dedup, lm_scoring, pii, simhash, toxicity, url_filter

LONG = ("the quick brown fox, jumps over 4111111111111111 lazy dogs. " * 3000).strip()
ROWS = [
    (1, "Some text here, mit license.", "x"), (1, "Some text here, mit license.", "x"), (2, "", "y"), (3, None, None), (None, "some TEXT here, mit license.", "z"), (None, None, "w"),
    (4, LONG, "x"), (5, LONG.upper(), "x"), (6, "é😀 \x00 word", "x"), (7, " \t\n\x0b\r ", "x"),
]
SCHEMA = "doc_id long, text string, keep_id string"


def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def labels(spark):
    return spark.createDataFrame([(1, 1), (4, 0), (None, 1), (2, None), (1, 0)], "doc_id long, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "jumps over 4111111111111111 lazy dogs the quick brown fox"), (2, None), (None, "x"), (3, ""), (4, "short")], "item_id long, text string")


OPERATORS = {
    "exact": lambda s, d: exact_dedup.exact_groups(d),
    "license": lambda s, d: license_scan.scan(d),
    "lines": lambda s, d: line_dedup.repeated_runs(d),
    "lines deleted": lambda s, d: line_dedup.delete_repeats(d),
    "benchmark": lambda s, d: decontaminate.contaminations(d, benchmark(s)),
    "bpe": lambda s, d: bpe.encode_documents(d, path(), ids=True),
    "lm": lambda s, d: lm_scoring.score_documents(d, classes=8, held=4),
    "toxicity": lambda s, d: toxicity.score_documents(d, toxicity.fit(d, labels(s))),
    "simhash": lambda s, d: simhash.near_groups(d),
    "pii": lambda s, d: pii.pseudonymise(d, b"k"),
}


@pytest.fixture(scope="module")
def docs(spark):
    # Columns with the names that operators use for their own.
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(1) for c in ("kept", "fp", "row", "h", "w", "low", "score", "_digest")})


@pytest.mark.parametrize("name", list(OPERATORS))
def test_one_row_per_row(spark, docs, name):
    got = OPERATORS[name](spark, docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", list(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, spark.createDataFrame([], SCHEMA)).collect() == []


def test_urls(spark):
    rows = [(1, None, "a"), (1, "http://a.net/x", "a"), (None, "", "b"), (2, "no scheme", "c"), (3, "http://", "c"), (4, "x" * 50000 + "://h/p", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string").withColumn("verdict", F.lit(1))
    assert url_filter.judge_urls(df).count() == len(rows)
    assert url_filter.judge_urls(df.limit(0)).count() == 0


CLASHES = ("k", "r", "_gone_key", "_digest", "_body", "keep_id", "row_key", "fp", "y", "part", "items", "kept", "_nth", "_row_sha", "_row_key")


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, tmp_path, k):
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    name, step = corpus_pipeline.STAGES[k]
    rows = [(i, t, "en", "s", 1) for i, t, _ in ROWS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(c) for c in CLASHES})
    out = step(spark, df, str(tmp_path))
    if k < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == df.columns
        assert all(r[c] == c for r in out.collect() for c in CLASHES)
    got = [r.doc_id for r in out.collect()]
    assert len(got) <= len(rows)
    if name == "exact dedup":  # null and empty are equal texts; a null id loses against any other
        assert sorted(map(str, got)) == ["1", "3", "5", "6", "7"]
    if name == "benchmark decontamination":
        assert 4 not in got and 5 not in got and 1 in got
    assert step(spark, df.limit(0), str(tmp_path)).count() == 0


@pytest.mark.parametrize("k", (0, 3))
def test_stages_with_empty_side_tables(spark, tmp_path, k):
    labels(spark).limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark).limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert corpus_pipeline.STAGES[k][1](spark, df, str(tmp_path)).count() == len(ROWS)

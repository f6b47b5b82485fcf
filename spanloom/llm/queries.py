"""The corpus operators' queries over the test tables, and their DuckDB statements where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, license_scan, line_dedup, lm_scoring, pii, simhash, toxicity, url_filter
from .common import table

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_runs(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    item_ids = F.transform("items", lambda x: x["item_id"])
    return found.select("doc_id", "contaminated", F.size("items").alias("n_items"), item_ids.alias("item_ids"), F.array_min(F.transform("items", lambda x: x["edits"])).alias("least_edits"))


def op6_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """`tokenizer_path`: the vocabulary file, at the same place on every machine; the public one by default."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).drop("passages")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


#: The key of the query over the test tables, published and so no secret; real data need one of their own.
DEMO_KEY = b"published key of the demonstration"


def op10_pii(spark: SparkSession, sf_dir: str, key: bytes = DEMO_KEY) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_line_dedup": op2_line_dedup,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_decontamination": op5_decontamination,
    "op6_bpe": op6_bpe,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_toxicity": op8_toxicity,
    "op9_simhash": op9_simhash,
    "op10_pii": op10_pii,
}

#: The rules, both models, the calibration and the verdict of every URL.
URL_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, coalesce(url, '') AS url,
             CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT rid, page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r AS (SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
             WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
             WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
             WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
j AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS says, substr(md5(url), 1, 1) IN ('0', '1', '2') AS held,
        list_transform(string_split('^^' || regexp_replace(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000'), '[^/._%=&+0a-z-]', '~', 'g') || '$', ''),
                       lambda x: strpos('{url_filter.ALPHABET}', x) - 1) AS codes FROM r),
t AS (SELECT *, list_transform(range(3, len(codes) + 1), lambda i: (codes[i - 2] * {url_filter.SIZE} + codes[i - 1]) * {url_filter.SIZE} + codes[i]) AS ids FROM j),
s AS (SELECT id, sum((says = 'allow')::INTEGER)::DOUBLE AS allow, sum((says = 'block')::INTEGER)::DOUBLE AS block FROM (SELECT unnest(ids) AS id, says FROM t WHERE says IS NOT NULL AND NOT held) GROUP BY id),
g AS (SELECT i AS id, i // {url_filter.SIZE} AS ab, i % {url_filter.SIZE**2} AS bc, (i // {url_filter.SIZE}) % {url_filter.SIZE} AS b, i % {url_filter.SIZE} AS c, coalesce(allow, 0.0) AS na, coalesce(block, 0.0) AS nb FROM range({url_filter.SIZE**3}) x(i) LEFT JOIN s ON s.id = i),
w AS (SELECT *, {", ".join(f"sum(n{k}) OVER (PARTITION BY {x}) AS n{k}_{x}" for k in "ab" for x in ("ab", "bc", "b", "c"))}, sum(na) OVER () AS ta, sum(nb) OVER () AS tb FROM g),
m AS (SELECT id, round(({" - ".join(f"ln((n{k} + 4.0 * ((n{k}_bc + 4.0 * ((n{k}_c + 1.0) / (t{k} + {url_filter.SIZE}.0))) / (n{k}_b + 4.0))) / (n{k}_ab + 4.0))" for k in "ab")}) * 1000000.0)::BIGINT AS ratio FROM w),
e AS (SELECT rid, unnest(ids) AS id FROM t),
v AS (SELECT rid, sum(ratio)::DOUBLE / (count(*) * 1000000.0::DOUBLE) AS score FROM e JOIN m USING (id) GROUP BY rid),
z AS (SELECT t.*, v.score FROM t JOIN v USING (rid)),
k AS (SELECT floor(score * 100)::BIGINT AS bin, sum((says = 'allow')::INTEGER) AS a, sum((says = 'block')::INTEGER) AS b FROM z WHERE says IS NOT NULL AND held GROUP BY 1),
q AS (SELECT bin, coalesce(sum(b) OVER o, 0) / nullif(sum(b) OVER (), 0)::DOUBLE - coalesce(sum(a) OVER o, 0) / nullif(sum(a) OVER (), 0)::DOUBLE AS gain FROM k WINDOW o AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT coalesce((SELECT bin / 100.0::DOUBLE FROM q WHERE gain > 0 ORDER BY gain DESC, abs(bin), bin DESC LIMIT 1), 0.0) AS threshold)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN score < threshold THEN 'block' ELSE 'allow' END) AS verdict, score FROM z, c"""

ORACLES: dict[str, str] = {
    "op1_url_filter": URL_SQL,
    "op3_exact_dedup": f"""
        WITH rows AS (SELECT doc_id, {LOWER} AS body FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM rows WINDOW same AS (PARTITION BY body)""",
}

"""From raw documents to tokens: toxicity, exact copies, near copies, benchmark passages, byte-pair encoding.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame; all but the
last return the columns of documents. run() writes each stage's result to shared storage and reads it again, so a
lost executor never reaches behind the stage that runs. In every stage null texts count as empty, rows with a null id
are documents like any other, an empty table passes through as an empty table, and further columns pass through
unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from spanloom.llm.common import free, stage, table


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from their labels, does not call toxic. Repeated rows and ties share a verdict."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id; of rows that tie one stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest doc_id; of rows that tie the one with the lowest digest."""
    return simhash.drop_near_copies(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Repeated rows share a verdict; an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Token counts and digests of ids and decoded texts, a row for each row; an empty text has no tokens."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_documents(docs, tokenizer_path)


STAGES = [
    ("toxicity", not_toxic),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_free),
    ("BPE encoding and decoding", tokens),
]

#: SQL cannot express the classifier, the fingerprints or the tokens; tests/llm compares with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
        free(before)  # nothing reads it any more
    return STAGES[-1][1](spark, docs, sf_dir)

"""Exact duplicates by skew-safe combining: local, salted and global stages that compare whole content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, stage

#: Each digest is dealt to so many reducers before its winners meet; bounds what one hot text sends anywhere.
SALTS = 16


def _sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def _combined(rows: DataFrame, salts: int) -> DataFrame:
    """(_digest, _body, keep_id, group_size), one row per distinct text.

    Stage 1 is the map-side half of the first aggregation (each task meets its own copies), stage 2 its
    reduce side, keyed by digest, salt and text, stage 3 joins the at most `salts` winners of a text. The
    grouping keys hold the whole text, so equal digests never merge different texts.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    winners = salted.groupBy("_digest", "_salt", "_body").agg(F.max("doc_id").alias("_top"), F.count(F.lit(1)).alias("_n"))
    return (
        winners.repartition("_digest")
        .groupBy("_digest", "_body")
        .agg(F.max("_top").alias("keep_id"), F.sum("_n").alias("group_size"))
    )


def _digests(rows: DataFrame, salts: int) -> DataFrame:
    """(_digest, _variants, keep_id, group_size), one staged row per digest; a digest with one variant is one text."""
    texts = _combined(rows, salts).groupBy("_digest")
    return stage(texts.agg(F.count(F.lit(1)).alias("_variants"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")), "digests")


def exact_groups(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null text counts as empty; the largest doc_id
    stays, null ids sort below all others, and of repeated rows with the same id exactly one is kept. An
    empty table gives an empty result; other columns of `docs` are ignored, whatever their names.

    Only digests travel back to the documents. That is exact where a digest has one text, which the
    combining stages have just proven by comparing content; should digests ever collide, those documents,
    and they alone, are joined by content.
    """
    rows = docs.select("doc_id", lower_ascii(F.col("text")).alias("_body")).withColumn("_digest", digest(F.col("_body")))
    groups = _digests(rows, salts)
    sha = F.col("_digest") if digest is _sha256 else F.sha2("_body", 256)
    slim = rows.select("doc_id", "_digest", sha.alias("text_sha256"))
    found = slim.join(groups.filter("_variants = 1").drop("_variants"), "_digest")
    clashes = groups.filter("_variants > 1").select("_digest")
    if not clashes.isEmpty():
        among = rows.join(clashes, "_digest", "left_semi")
        found = found.unionByName(
            among.withColumn("text_sha256", F.sha2("_body", 256)).join(_combined(among, salts), ["_digest", "_body"]).drop("_body")
        )
    winner = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    nth = F.row_number().over(Window.partitionBy("text_sha256", "doc_id").orderBy(F.lit(1)))
    return found.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (winner & (nth == 1)).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, salts: int = SALTS, digest: Callable[[Column], Column] = _sha256) -> DataFrame:
    """`docs` with one row of each group of equal texts, the one with the largest doc_id; all columns as they were.

    Null and empty texts are equal texts; null ids lose against any other. Of rows that share id and text one
    stays. An empty table stays empty. Rows travel as one struct, so columns may have any names.

    Which ids stay is known from the digests alone. Rows with the same id and text meet where they are read before
    the texts move, once, to the key by which the ids that stay are known.
    """
    body = lower_ascii(F.col("text"))
    groups = _digests(docs.select("doc_id", body.alias("_body")).withColumn("_digest", digest(F.col("_body"))), salts)
    proven = [r["_digest"] for r in groups.filter("_variants > 1").select("_digest").collect()]  # colliding digests: none with SHA-256
    whole = lambda of, text: F.when(of.isin(proven), text) if proven else F.lit(None).cast("string")  # noqa: E731  else the digest is the text
    key = lambda i, of, text: F.unhex(F.sha2(F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), of, whole(of, text)), 256))
    keep = groups.filter("_variants = 1").select(key(F.col("keep_id"), F.col("_digest"), F.lit(None).cast("string")).alias("k"))
    if proven:
        rows = docs.select("doc_id", body.alias("_body")).withColumn("_digest", digest(F.col("_body"))).filter(F.col("_digest").isin(proven))
        keep = keep.union(_combined(rows, salts).select(key(F.col("keep_id"), F.col("_digest"), F.col("_body"))))
    one = docs.select(key(F.col("doc_id"), digest(body), body).alias("k"), F.struct("*").alias("r")).groupBy("k").agg(F.first("r").alias("r"))
    return one.join(keep, "k", "left_semi").select("r.*")

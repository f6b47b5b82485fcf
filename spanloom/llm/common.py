"""Helpers shared by the corpus operators: tables, staging on shared storage, text normalisation."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the white-space contracts.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, everything else as it is; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


_OWN_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where that is unset (tests, local runs)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="spanloom-stage-")
        spark.sparkContext.setCheckpointDir(_OWN_DIRS[app])
    return _OWN_DIRS[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def stage(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table to shared storage and read it back.

    This cuts lineage: what is downstream survives lost executors without recomputing what is
    upstream, and nondeterministic columns (row numbers) are drawn once. Dropped by free(), or when Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    atexit.register(_drop, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    weakref.finalize(out, _PATHS.pop, id(out), None)
    return out


_PATHS: dict[int, str] = {}


def free(staged: DataFrame) -> None:
    """Drop what stage() wrote; for tables that no plan still to run reads."""
    if path := _PATHS.get(id(staged)):
        _drop(staged.sparkSession, path)

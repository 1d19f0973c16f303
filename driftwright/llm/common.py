"""Shared folders, written tables and small helpers for the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwright.storage import discard, new_path, shared_dir, written  # noqa: F401

@contextlib.contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """Arrow batches of at most so many rows in the jobs that are run inside: for rows with long values."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, most)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of frames that nothing refers to any more; else they stay until the driver's memory fills up."""
    gc.collect()
    spark._jvm.System.gc()


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the system; else it stays with the worker, beside the next one's."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have no need of it
    if give_back is not None:
        give_back(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    """Lower-cases A-Z only, unlike lower()."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that a result column will replace (names compared without case, as Spark does)."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def nested(df: DataFrame, *extra) -> DataFrame:
    """All columns of df in one struct, held, which no other column can clash with, and extra columns beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("held"), *extra)


def unnested(df: DataFrame, like: DataFrame, *names: str) -> DataFrame:
    """What nested() has put away, without columns that bear one of the names, and the named columns of df."""
    return df.select(*[F.col(f"held.`{c}`").alias(c) for c in without(like, *names).columns], *names)


def filesystem(uri: str):
    """A pyarrow file system and path for a folder in any shared store; usable on driver and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)

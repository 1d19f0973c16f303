"""Snapshot comparison: one full outer join by key, a cascade of cheap rules, and hashes only where those leave a doubt.

A snapshot is a frame with path, is_dir, size, mtime_raw and, where contents are to be compared,
hash (null: unreadable). Modes: size (sizes alone), fast (sizes, then times within a tolerance, then
hashes), strict (sizes, then hashes).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftwright.functions.scalars import same_time

MODES = ("size", "fast", "strict")
CATEGORIES = ("SAME", "DIFF", "MISSING", "EXTRA")


def last_wins(snapshot: DataFrame, seq: str) -> DataFrame:
    """One row a path: the one of the highest seq."""
    w = Window.partitionBy("path").orderBy(F.desc(seq))
    return snapshot.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def files(snapshot: DataFrame) -> DataFrame:
    return snapshot.filter(~F.col("is_dir"))


def decision(mode: str, remote_size: Column, local_size: Column, remote_time: Column, local_time: Column) -> Column:
    """SAME, DIFF, MISSING, EXTRA or HASH (undecided) from metadata alone."""
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    both = {"size": F.lit("SAME"), "strict": F.lit("HASH"), "fast": F.when(same_time(local_time, remote_time), "SAME").otherwise("HASH")}[mode]
    return F.when(remote_size.isNull(), "EXTRA").when(local_size.isNull(), "MISSING").when(remote_size != local_size, "DIFF").otherwise(both)


def decided(remote: DataFrame, local: DataFrame, mode: str) -> DataFrame:
    """path, local_size, remote_size, times, hashes if present, and outcome; one shuffle of both sides by path."""
    keep = lambda df, side: files(df).select("path", *[F.col(c).alias(f"{side}_{c}") for c in ("size", "mtime_raw", "hash") if c in df.columns])
    both = keep(remote, "remote").join(keep(local, "local"), "path", "full_outer")
    return both.withColumn("outcome", decision(mode, *(F.col(c) for c in ("remote_size", "local_size", "remote_mtime_raw", "local_mtime_raw"))))


def compare(remote: DataFrame, local: DataFrame, mode: str, hashes: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """category, path, local_size, remote_size and hash_compared of every file.

    Without `hashes`, both snapshots carry a hash column. With it, `hashes` gets only the undecided
    rows and returns them with remote_hash and local_hash, so a costly reader (a Python function
    over files) runs for nothing else: the frame is split first, as the optimizer would not do it.
    """
    rows = decided(remote, local, mode)
    if hashes is not None:
        open_ = hashes(rows.filter("outcome = 'HASH'"))
        rows = rows.filter("outcome <> 'HASH'").withColumns({"remote_hash": F.lit(None).cast("string"), "local_hash": F.lit(None).cast("string")}).unionByName(open_.select(*rows.columns, "remote_hash", "local_hash"))
    by_hash = F.when(F.coalesce(F.col("remote_hash") == F.col("local_hash"), F.lit(False)), "SAME").otherwise("DIFF")
    return rows.select(
        F.when(F.col("outcome") == "HASH", by_hash).otherwise(F.col("outcome")).alias("category"), "path", "local_size", "remote_size", (F.col("outcome") == "HASH").alias("hash_compared")
    )


def counters(compared: DataFrame) -> DataFrame:
    """One row: enumerated, same, diff, missing, extra_local, total (extras don't count) and verdict (0: equal)."""
    n = {c: F.count_if(F.col("category") == c) for c in CATEGORIES}
    return compared.agg(
        (n["SAME"] + n["DIFF"] + n["MISSING"]).alias("enumerated"), n["SAME"].alias("same"), n["DIFF"].alias("diff"), n["MISSING"].alias("missing"), n["EXTRA"].alias("extra_local"),
        (n["SAME"] + n["DIFF"] + n["MISSING"]).alias("total"), F.when(n["DIFF"] + n["MISSING"] + n["EXTRA"] == 0, 0).otherwise(1).alias("verdict"),
    )


def extras(remote: DataFrame, local: DataFrame) -> DataFrame:
    return files(local).join(files(remote).select("path"), "path", "left_anti")


def compare_tables(remote: DataFrame, local: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed tables compared by the hash of all their other columns: keys, category."""
    others = [c for c in remote.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.md5(F.to_json(F.struct(*others), {"ignoreNullFields": "false"})).alias(name))
    both = side(remote, "r").join(side(local, "l"), keys, "full_outer")
    return both.select(*keys, F.when(F.col("r").isNull(), "EXTRA").when(F.col("l").isNull(), "MISSING").when(F.col("r") == F.col("l"), "SAME").otherwise("DIFF").alias("category"))


def cached_hashes(snapshot: DataFrame, cache: DataFrame) -> DataFrame:
    """snapshot with cached_hash: of a cache row with the same path, size and time (null: no such row)."""
    c = cache.select("path", "size", "mtime_raw", F.col("hash").alias("cached_hash"))
    return snapshot.join(c, ["path", "size", "mtime_raw"], "left")

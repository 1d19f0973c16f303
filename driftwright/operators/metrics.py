"""Histograms and percentiles of snapshots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGES = ((4 << 10, "<4K"), (16 << 10, "<16K"), (64 << 10, "<64K"), (256 << 10, "<256K"), (1 << 20, "<1M"))


def size_bucket(size: Column) -> Column:
    out = F.lit(">=1M")
    for edge, name in reversed(EDGES):
        out = F.when(size < edge, name).otherwise(out)
    return out


def size_histogram(snapshot: DataFrame) -> DataFrame:
    return snapshot.groupBy(size_bucket(F.col("size")).alias("bucket")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


#: Bits of a value that a pass of the percentile search counts; 2 to this power rows at most for each share.
DIGIT = 12


def nearest_rank(df: DataFrame, value: str, shares: tuple = (0.5, 0.95, 0.99, 1.0)) -> DataFrame:
    """share and value (whole numbers) at index floor(share * (n - 1) + 0.5) of the sorted values; no rows without values.

    A search by digits: each pass counts the values by their next DIGIT bits, within the digits found
    so far, and keeps for each share the digit that holds its index. So a pass aggregates to a bounded
    number of rows whatever the number of different values, and nothing is sorted.
    """
    spark = df.sparkSession
    rows = df.select(F.col(value).cast("long").alias("v")).filter("v IS NOT NULL")
    n, least, most = rows.agg(F.count("*"), F.min("v"), F.max("v")).collect()[0]
    kind = df.schema[value].dataType
    if not n:
        return spark.createDataFrame([], f"share double, value {kind.simpleString()}")
    left = max(1, (most - least).bit_length())
    if left > 63:
        raise ValueError("the values span more than 63 bits")
    keys = rows.select((F.col("v") - least).alias("v"))
    found = {s: (0, math.floor(s * (n - 1) + 0.5)) for s in shares}  # digits so far, index within them
    while left:
        step = min(DIGIT, left)
        left -= step
        digits = F.shiftright("v", left)
        tops = sorted({top for top, _ in found.values()})
        inside = keys.filter(F.shiftright("v", left + step).isin(tops) if left + step < 63 else F.lit(True))
        counts = sorted((r["d"], r["c"]) for r in inside.groupBy(digits.alias("d")).agg(F.count("*").alias("c")).collect())
        for s, (top, at) in found.items():
            for d, c in counts:
                if d >> step == top:
                    if at < c:
                        found[s] = (d, at)
                        break
                    at -= c
    return spark.createDataFrame([(float(s), least + v) for s, (v, _) in found.items()], "share double, value long").select("share", F.col("value").cast(kind))


def log2_bucket(x: Column) -> Column:
    """floor(log2(x)) of a whole number, exactly: 0 for 0 and 1, 31 at most."""
    return F.when(x <= 1, 0).otherwise(F.least(F.lit(31), F.length(F.bin(x)) - 1))


def log2_p95(df: DataFrame, value: str) -> DataFrame:
    """One row: the upper edge of the power-of-two bucket where 95 % of the values are reached, 2^31 at most; 0 without values."""
    hist = df.filter(F.col(value).isNotNull()).groupBy(log2_bucket(F.col(value)).alias("b")).agg(F.count("*").alias("c"))
    bins = F.coalesce(F.map_from_entries(F.collect_list(F.struct("b", "c"))), F.create_map().cast("map<int,bigint>"))  # 32 at most
    each = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.coalesce(bins[b], F.lit(0).cast("long")))
    one = hist.agg(each.alias("h")).withColumn("target", F.expr("(aggregate(h, 0L, (a, x) -> a + x) * 95 + 99) div 100"))
    at = F.expr("array_position(transform(sequence(0, 31), i -> aggregate(slice(h, 1, i + 1), 0L, (a, x) -> a + x) >= target), true)").cast("int")
    return one.select(F.when(F.col("target") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.least(F.lit(31), at))).alias("p95_upper"))


def throughput_mbps(total_bytes: Column, seconds: Column) -> Column:
    return total_bytes.cast("double") * 8.0 / F.greatest(F.lit(1e-9), seconds) / 1e6


def mean_wait(total: Column, count: Column) -> Column:
    """Integer mean, 0 of none."""
    return F.when(count > 0, F.call_function("div", total, count)).otherwise(F.lit(0).cast("long"))


def least_rtt(matrix: DataFrame, group: str) -> DataFrame:
    """The least round trip over each group's reachable cells; null if none is."""
    return matrix.groupBy(group).agg(F.min(F.when(F.col("reachable"), F.col("rtt"))).alias("rtt"))


def session_counts(sessions: DataFrame) -> DataFrame:
    """One row: active sessions and all that were created, from end_ts (null: still active)."""
    return sessions.agg(F.count_if(F.col("end_ts").isNull()).alias("active"), F.count("*").alias("created"))

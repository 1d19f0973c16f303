"""Snapshots and series derived from the driver tables, for the catalog's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remote_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "concat('docs/', lang, '/', source, '/', doc_id, '.txt') AS path", "false AS is_dir", "CAST(octet_length(text) AS BIGINT) AS size",
        "1700000000000000000 + doc_id * 1000000000 AS mtime_raw", "md5(text) AS hash",
    )


def local_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remote side with every tenth file missing, others changed by the last digit of the id, and extra files."""
    docs = table(spark, sf_dir, "documents")
    kept = docs.filter("doc_id % 10 <> 0").selectExpr(
        "concat('docs/', lang, '/', source, '/', doc_id, '.txt') AS path", "false AS is_dir",
        "CAST(octet_length(text) AS BIGINT) + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS size",
        """CASE WHEN doc_id % 10 IN (2, 3) THEN 1700000000000000000 + doc_id * 1000000000 + 10000000
                WHEN doc_id % 10 = 4 THEN 1700000000000000000 + doc_id * 1000000000 + 2000000
                WHEN doc_id % 10 = 5 THEN 1700000000000000000 + doc_id * 1000000000 + 2000001
                WHEN doc_id % 10 = 6 THEN 133444736000000000 + doc_id * 10000000
                ELSE 1700000000000000000 + doc_id * 1000000000 END AS mtime_raw""",
        "CASE WHEN doc_id % 10 IN (1, 2, 7) THEN md5(concat(text, '#')) ELSE md5(text) END AS hash",
    )
    extra = docs.filter("doc_id % 25 = 0").selectExpr("concat('extra/', doc_id, '.txt')", "false", "CAST(octet_length(text) AS BIGINT)", "1700000000000000000", "md5(text)")
    return kept.union(extra)


def directories(manifest: DataFrame) -> DataFrame:
    from driftwright.operators.planning import ancestors

    return ancestors(manifest.select("path"))


def lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_nationkey AS grp", "s_suppkey AS lane", "s_suppkey % 7 <> 0 AS healthy", "s_suppkey % 5 AS in_flight", "CAST(1 + s_suppkey % 3 AS DOUBLE) AS weight", "s_suppkey % 2 AS bias"
    )


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One probed cell for each customer: a client interface, a server interface, and what the probe found."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_nationkey AS grp", "concat('c', c_custkey % 4) AS client", "concat('s', c_nationkey % 3) AS server", "CAST(c_custkey AS BIGINT) AS edge", "c_custkey % 2 AS family",
        "(c_custkey div 2) % 2 AS subnet", "CAST((c_custkey * 7 + c_nationkey * 13) % 100 AS DOUBLE) AS rtt", "(c_custkey + c_nationkey) % 5 <> 0 AS reachable",
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as windows of the write-cap controller, in order (a user's events are few)."""
    e = table(spark, sf_dir, "events")
    x = F.expr("""struct(event_id % 60 AS backlog, (event_id * 7919) % 1000 AS in_flight, event_id % 300 AS outstanding, 1200L AS budget, coalesce(value, 0D) AS rate,
        CAST((event_id % 40) * 1000000000L AS DOUBLE) AS latency, event_id % 29 = 0 AS backpressure, CASE WHEN event_id % 31 = 0 THEN 1 ELSE 0 END AS failures)""")
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", x.alias("x")))).alias("r"))
    return rows.select("user_id", F.transform("r", lambda r: r["x"]).alias("samples"))


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One session for each user and hour with events."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("h")).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")).withColumn("session_id", F.xxhash64("user_id", "h"))


def user_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event values in order of time, as one array (a user's events are few)."""
    e = table(spark, sf_dir, "events")
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("r"))
    return rows.select("user_id", F.transform("r", lambda x: F.coalesce(x["value"], F.lit(0.0))).alias("values"))

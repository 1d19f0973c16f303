"""Incremental comparison: a manifest that arrives in parts and says itself when it is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwright.operators.compare import compare, extras

MANIFEST = "path string, is_dir boolean, size long, mtime_raw long, hash string, is_end boolean"


def compare_arriving(spark: SparkSession, arriving: str, local: DataFrame, out: str, checkpoint: str, mode: str = "fast") -> bool:
    """Compares the manifest rows that have come since the last call, and the extras once the end marker has come; says whether it has.

    arriving: folder of Parquet parts of MANIFEST; the row with is_end ends it. Each part's files are
    compared with `local` and written below `out`, a folder for each batch, so a batch that is run
    again replaces its own result. Files that only `local` has are known (and written) only after
    the end: until then a file may still come, and nothing may be deleted. A call after the end does
    the extras again, in the same place.
    """
    parts = spark.readStream.schema(MANIFEST).option("pathGlobFilter", "*.parquet").parquet(arriving)

    def one(batch: DataFrame, number: int) -> None:
        batch = batch.sparkSession.createDataFrame([], batch.schema) if batch.isEmpty() else batch
        rows = batch.filter(~F.coalesce("is_end", F.lit(False))).drop("is_end")
        here = local.join(rows.select("path"), "path", "left_semi")
        compare(rows, here, mode).write.mode("overwrite").parquet(f"{out}/batch={number}")

    parts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    came = spark.read.schema(MANIFEST).parquet(arriving)
    if came.filter("is_end").isEmpty():
        return False
    gone = extras(came.filter("NOT coalesce(is_end, false)"), local)
    gone.select(F.lit("EXTRA").alias("category"), "path", F.col("size").alias("local_size"), F.lit(None).cast("long").alias("remote_size"), F.lit(False).alias("hash_compared")).write.mode("overwrite").parquet(f"{out}/batch=end")
    return True


def compared_so_far(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("category string, path string, local_size long, remote_size long, hash_compared boolean, batch string").parquet(out).drop("batch")

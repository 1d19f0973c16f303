"""Tables written to the folder that driver and executors share, to cut lineage and to fix what is read twice."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}
#: Rows of a file of a table whose number of rows is known and whose rows are short.
FILE_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset and the master is local (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _own_dir.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="driftwright-"))
    return base.rstrip("/") + "/driftwright"


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors. rows: at most about so many, so that a small table is a few files."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = new_path(spark, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._driftwright_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_driftwright_path", None)
        if path:
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)

"""Directory trees as a data source, which Spark's own listing does not give: hidden, empty and underscore files stay, and times keep nanoseconds."""

from __future__ import annotations

import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


#: Directories of a level that are enough to read in parallel, and directories that the driver lists at most.
ENOUGH_PARTS, MOST_PARTS = 64, 4096


@dataclass
class Subtree(InputPartition):
    path: str
    deep: bool


class TreeSource(DataSource):
    """path, is_dir, size and mtime_raw of everything below option `path`, plus content with option content=true.

    Partitions are subtrees of the first level that has ENOUGH_PARTS directories. Links to files
    count as files; links to directories are listed, not followed. A directory that can't be listed
    is empty; of what can't be examined, size and time are 0; contents that can't be read are null.
    """

    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        content = ", content binary" if self.options.get("content", "false") == "true" else ""
        return f"path string, is_dir boolean, size long, mtime_raw long{content}"

    def reader(self, schema):
        return _TreeReader(self.options)


class _TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.content = options.get("content", "false") == "true"
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)

    def partitions(self):
        """The directories of the widest level that has MOST_PARTS at most, each read in depth, and the levels above, each directory alone."""
        alone, level = [], [""]
        while True:
            below = []
            for at in level:
                try:
                    with os.scandir(os.path.join(self.root, at)) as entries:
                        below += sorted(f"{at}/{e.name}" if at else e.name for e in entries if e.is_dir(follow_symlinks=False))
                except OSError:
                    continue
            if not below or len(alone) + len(level) + len(below) > MOST_PARTS:
                return [Subtree(at, False) for at in alone] + [Subtree(at, True) for at in level]
            alone, level = alone + level, below
            if len(level) >= ENOUGH_PARTS:
                return [Subtree(at, False) for at in alone] + [Subtree(at, True) for at in level]

    def read(self, partition):
        todo = [partition.path]
        while todo:
            at = todo.pop()
            try:
                with os.scandir(os.path.join(self.root, at)) as found:
                    entries = sorted(found, key=lambda e: e.name)
            except OSError:
                continue
            for e in entries:
                path = f"{at}/{e.name}" if at else e.name
                try:
                    is_dir = e.is_dir()
                    if not is_dir and not e.is_file():
                        continue
                except OSError:
                    continue
                try:
                    info = e.stat()
                    size, mtime = 0 if is_dir else info.st_size, info.st_mtime_ns
                except OSError:
                    size, mtime = 0, 0
                yield (path, is_dir, size, mtime, None if is_dir else _bytes(e.path)) if self.content else (path, is_dir, size, mtime)
                if is_dir and partition.deep and not e.is_symlink():
                    todo.append(path)


def _bytes(path: str, offset: int = 0, length: int = -1) -> bytes | None:
    """Bytes of a file; null if it can't be read."""
    try:
        with open(path, "rb") as f:
            f.seek(offset)
            return f.read(length)
    except OSError:
        return None


def read_ranges(root: str, ranges: DataFrame) -> DataFrame:
    """ranges (path, offset, length) with data and error: range (a length of 0 or less, a negative offset, or more than the file has), unreadable, or null.

    A bad range never fails the others. root: a folder that all executors see.
    """

    def run(batches):
        for batch in batches:
            data, error = [], []
            for path, at, n in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                bad = path is None or at is None or n is None or n <= 0 or at < 0 or at + n > (1 << 63) - 1
                raw = None if bad else _bytes(os.path.join(root, path), at, n)
                error.append("range" if bad else "unreadable" if raw is None else None if len(raw) == n else "range")
                data.append(raw if error[-1] is None else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary()), pa.array(error, pa.string())], names=[*batch.schema.names, "data", "error"])

    rows = ranges.drop("data", "error")
    return rows.mapInArrow(run, rows.withColumns({"data": F.lit(None).cast("binary"), "error": F.lit(None).cast("string")}).schema)


def probe(root: str, paths: DataFrame) -> DataFrame:
    """paths with ok (an ordinary file that can be opened) and size (null if not ok): one file that can't be read fails no other."""

    def look(path):
        try:
            full = os.path.join(root, path)
            if not os.path.isfile(full):
                return None
            with open(full, "rb") as f:
                return os.fstat(f.fileno()).st_size
        except (OSError, TypeError, ValueError):
            return None

    def run(batches):
        for batch in batches:
            size = pa.array([look(p) for p in batch.column("path").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, size.is_valid(), size], names=[*batch.schema.names, "ok", "size"])

    rows = paths.drop("ok", "size")
    return rows.mapInArrow(run, rows.withColumns({"ok": F.lit(False), "size": F.lit(None).cast("long")}).schema)


def read_tree(spark: SparkSession, root: str, *, content: bool = False, exclude: list[str] = ()) -> DataFrame:
    spark.dataSource.register(TreeSource)
    df = spark.read.format("tree").option("path", root).option("content", str(content).lower()).load()
    return df.filter(~F.col("path").isin(*exclude)) if exclude else df


def index_order(df: DataFrame) -> DataFrame:
    """Directories first, then by path."""
    return df.orderBy(F.desc("is_dir"), "path")


def hash_order(df: DataFrame) -> DataFrame:
    """Rows in path order within each task, so that a reader meets the files of a directory together."""
    return df.sortWithinPartitions("path")

"""Action plans: routes by size, batches, slices, directories to make and delete, guarded by a complete snapshot."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftwright.functions.scalars import long
from driftwright.storage import written


class IncompleteSnapshot(ValueError):
    """Deleting is refused unless the remote snapshot is known to be complete."""


def route(size: Column, batch_limit: int, large_from: int) -> Column:
    return F.when(size <= batch_limit, "batch").when(size >= large_from, "large").otherwise("regular")


def admits_delta(remote_size: Column, local_size: Column, least: int) -> Column:
    return F.coalesce((remote_size >= least) & (local_size > 0), F.lit(False))


def actions(compared: DataFrame, *, batch_limit: int, large_from: int, delta_from: int, touch: bool = True) -> DataFrame:
    """path and action: skip, touch (equal by hash, time differs), delta, batch, regular, large or delete_file."""
    move = F.when(admits_delta(F.col("remote_size"), F.col("local_size"), delta_from), "delta").otherwise(route(F.col("remote_size"), batch_limit, large_from))
    same = F.when(F.col("hash_compared"), "touch").otherwise("skip") if touch else F.lit("skip")
    return compared.select("path", F.when(F.col("category") == "SAME", same).when(F.col("category") == "EXTRA", "delete_file").otherwise(move).alias("action"))


def delete_plan(extra_paths: DataFrame, *, snapshot_complete: bool) -> DataFrame:
    """path and step: longest path (in bytes) first, ties by path. Refused for an incomplete snapshot.

    Steps are numbers from a global order; the ranges of a range partitioning give them, not one task.
    """
    if not snapshot_complete:
        raise IncompleteSnapshot("the remote snapshot is not complete")
    return numbered(extra_paths.select("path"), [F.desc(F.octet_length("path")), F.asc("path")], "step")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Consecutive numbers from 1 in a global order: places in the sorted partitions, plus the rows of those before."""
    ordered = written(df.orderBy(*order).withColumn("_i", F.monotonically_increasing_id()), "ordered")  # sorted once; every reading finds the same places
    part = F.shiftright("_i", 33)
    sizes = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("_before"))
    return ordered.join(F.broadcast(before), part == before["_p"]).withColumn(name, F.col("_i").bitwiseAND((1 << 33) - 1) + 1 + F.col("_before")).drop("_p", "_i", "_before")


def numbered_within(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Consecutive numbers from 1 in each group, as `numbered` gives them: a large group lies in many partitions, and no task holds it. Rows without a group are left out."""
    ordered = written(df.filter(F.col(group).isNotNull()).orderBy(group, *order).withColumn("_i", F.monotonically_increasing_id()), "ordered").withColumn("_p", F.shiftright("_i", 33))
    pieces = ordered.groupBy(group, "_p").agg(F.count("*").alias("n"), F.min("_i").alias("_first"))  # a row for each group in a partition
    before = F.sum("n").over(Window.partitionBy(group).orderBy("_p")) - F.col("n")
    shifts = written(pieces.select(group, "_p", (before - F.col("_first") + 1).alias("_shift")), "shifts")  # written, so that the join goes by its size
    return ordered.join(shifts, [group, "_p"]).withColumn(name, F.col("_i") + F.col("_shift")).drop("_p", "_i", "_shift")


def ancestors(paths: DataFrame) -> DataFrame:
    """Every directory above the files of `path`, once."""
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat_ws("/", F.slice(parts, 1, i)))
    return paths.filter(F.contains("path", F.lit("/"))).select(F.explode(up).alias("dir")).distinct()


def deepest(dirs: DataFrame) -> DataFrame:
    """Directories that the next one in byte order is not below (only the next one counts): a stays beside a-b and a/c, as a-b stands between.

    What follows d at once is below it if something starts with d and a slash, and nothing starts with
    d and a smaller byte. Both are properties of prefixes, so equal joins find them and nothing is sorted.
    """
    at = F.filter(F.sequence(F.lit(2), F.length("dir")), lambda i: F.substr("dir", i, F.lit(1)) <= "/")
    cuts = dirs.filter(F.length("dir") >= 2).select("dir", F.explode(at).alias("_i"))
    marks = cuts.select(F.substr("dir", F.lit(1), F.col("_i") - 1).alias("_dir"), (F.substr("dir", "_i", F.lit(1)) == "/").alias("_below"))
    marks = marks.groupBy("_dir").agg(F.every("_below").alias("_hides"))
    return dirs.join(marks, dirs["dir"] == marks["_dir"], "left").filter(~F.coalesce("_hides", F.lit(False))).drop("_dir", "_hides")


def empty_dirs(remote_dirs: DataFrame, remote_files: DataFrame, local_dirs: DataFrame) -> DataFrame:
    """Remote directories without files below them that the local side lacks."""
    return remote_dirs.join(ancestors(remote_files), "dir", "left_anti").join(local_dirs, "dir", "left_anti")


def slices(rows: DataFrame, length_col: str, slice_len: int, offset_col: str | None = None) -> DataFrame:
    """rows with offset and len of each slice; the last is shorter; a length of 0 has none."""
    base = F.col(offset_col) if offset_col else long(0)
    each = rows.filter(F.col(length_col) > 0).withColumn("_at", F.explode(F.sequence(long(0), F.col(length_col) - 1, long(slice_len))))
    return each.withColumns({"offset": base + F.col("_at"), "len": F.least(long(slice_len), F.col(length_col) - F.col("_at"))}).drop("_at")


def packed(files: DataFrame, group: str, *, max_files: int, max_bytes: int) -> DataFrame:
    """batch number within each group: a batch closes once it has max_files files or max_bytes bytes (the last file may overshoot).

    A running fold resets where a batch closes, which no window frame does, so rows pass in order of
    group and path through one loop a task, which keeps two counters and no group.
    """
    rows = files.select(group, "path", "size")

    def run(batches):
        last, batch, n, held = object(), 0, 0, 0
        for b in batches:
            out = []
            for g, size in zip(b.column(group).to_pylist(), b.column("size").to_pylist(), strict=True):
                if g != last:
                    last, batch, n, held = g, 0, 0, 0
                elif n >= max_files or held >= max_bytes:
                    batch, n, held = batch + 1, 0, 0
                n, held = n + 1, held + (size or 0)
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], names=[*b.schema.names, "batch"])

    return rows.repartition(group).sortWithinPartitions(group, "path").mapInArrow(run, rows.withColumn("batch", F.lit(0)).schema)


def sync_counters(done: DataFrame) -> DataFrame:
    """One row from actions and ok: unchanged, transferred, failed, deleted; deletions that fail count as failed, and compared leaves deletions out."""
    deletes, skip = F.col("action").startswith("delete"), F.col("action").isin("skip", "touch")
    return done.agg(
        F.count_if(skip).alias("unchanged"), F.count_if(~skip & ~deletes & F.col("ok")).alias("transferred"), F.count_if(~skip & ~F.col("ok")).alias("failed"),
        F.count_if(deletes & F.col("ok")).alias("deleted"), F.count_if(~deletes).alias("compared"),
    )


#: Queues in the order in which they are served.
QUEUES = ("batch", "regular", "retry_batch", "retry")


def queue_rank(queue: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, QUEUES)), queue).cast("int")


def admits_blocks(size: Column, healthy_lanes: Column, abandoned: Column, *, allowed: bool, capable: bool, threshold: int) -> Column:
    """Whether a file goes in blocks over several lanes: allowed, offered by the server, large, two healthy lanes or more, not abandoned."""
    return F.lit(allowed and capable) & (size >= threshold) & (healthy_lanes >= 2) & ~abandoned


def forces_primary(size: Column, policy: Column, weight: Column, threshold: int) -> Column:
    """Large files are pinned to the primary lane unless the policy is aux, or auto with a weight of 2 or more."""
    return (size >= threshold) & ~((policy == "aux") | ((policy == "auto") & (weight >= 2.0)))


def after_delta_failure(reason: Column, blocks: Column) -> Column:
    """Where a file goes when its delta fails: blocks if admissible, else whole; a failed signature always whole."""
    return F.when(reason == "sig_error", "whole").when(reason.isin("old_unreadable", "benefit", "reconstruct_io", "verify_fail"), F.when(blocks, "blocks").otherwise("whole"))


def releases_slot(range_tagged: Column, has_state: Column, has_signature: Column) -> Column:
    return ~range_tagged & has_state & ~has_signature


def write_accounting(ok: Column, fast: Column) -> Column:
    """(compared, transferred, driver, fast) that a finished write adds; a failed one adds nothing."""
    one = lambda c: F.when(c, 1).otherwise(0)
    return F.struct(one(ok).alias("compared"), one(ok).alias("transferred"), one(ok & ~fast).alias("driver"), one(ok & fast).alias("fast"))


def write_route(server_ok: Column, complete: Column) -> Column:
    """Complete entries, empty ones too, go to the write pool; others are closed and retried."""
    return F.when(server_ok & complete, "dispatch").otherwise("sync_fail")


#: Files up to this size are written in one call.
FAST_WRITE = 256 << 10


def write_path(size: Column) -> Column:
    return F.when(size <= FAST_WRITE, "fast").otherwise("driver")


def extra_dirs(remote_dirs: DataFrame, local_dirs: DataFrame) -> DataFrame:
    """Local directories that the remote side lacks."""
    return local_dirs.join(remote_dirs, "dir", "left_anti")


def forced(undecided: DataFrame, responses: DataFrame) -> DataFrame:
    """path and action of undecided files once no more hashes come: TRANSFER without a response, else by the hashes.

    undecided: path, local_hash; responses: path, remote_hash. See hash_outcome for marks in hashes.
    """
    both = undecided.join(responses.withColumn("_answered", F.lit(True)), "path", "left")
    return both.select("path", F.when(F.col("_answered").isNull(), "TRANSFER").otherwise(hash_outcome(F.col("remote_hash"), F.col("local_hash"))).alias("action"))


def hash_outcome(remote: Column, local: Column) -> Column:
    """SAME or DIFF by binary hashes: 16 bytes 0xFF from the server stand for a failed read, which differs, and a null never equals."""
    failed = remote == F.unhex(F.lit("FF" * 16))
    return F.when(F.coalesce(~failed & (remote == local), F.lit(False)), "SAME").otherwise("DIFF")


def needs_verify(wanted: Column) -> Column:
    """Whether a written file is verified: 16 zero bytes (or null) stand for no hash."""
    return F.coalesce(wanted != F.unhex(F.lit("00" * 16)), F.lit(False))


def range_lanes(ranges: DataFrame, lanes: DataFrame, group: str, *, stream_limit: int) -> DataFrame:
    """ranges (group, path, offset) with the lane that each starts on now; ranges that must wait are left out.

    A group's ranges go in order to the healthy lane of least (in_flight + bias) / weight below the
    stream limit, ties to the lowest, and each adds one to its lane. lanes: group, lane, healthy,
    in_flight, weight (above 0), bias; a lane without a load takes none.

    A lane's load only grows as ranges come, so the lanes are taken in the order of the loads of all
    their free slots: the nth range of a group takes its nth slot. Both sides are numbered by sorting.
    """
    free = lanes.filter(F.col("healthy") & (F.col("in_flight") < stream_limit)).withColumn("_at", F.explode(F.sequence(F.col("in_flight").cast("long"), long(stream_limit - 1))))
    loads = free.withColumn("_load", (F.col("_at") + F.col("bias")).cast("double") / F.col("weight")).filter(F.col("_load").isNotNull())
    slots = numbered_within(loads.select(group, F.col("lane").cast("long").alias("lane"), "in_flight", "bias", "weight", "_at", "_load"), group, ["_load", "lane", "in_flight", "bias", "weight", "_at"], "_n").select(group, "_n", "lane")
    asked = ranges.select(group, "path", "offset").join(slots.groupBy(group).agg(F.max("_n").alias("_most")), group)
    first = numbered_within(asked, group, ["path", "offset"], "_n").filter(F.col("_n") <= F.col("_most"))
    return first.join(slots, [group, "_n"]).select(group, "path", "offset", "lane")

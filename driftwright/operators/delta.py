"""Block deltas: signatures, rolling weak checksums, greedy block matching, plans and verified reconstruction."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwright.functions.scalars import long

EARLY_STRIDE = 4 << 20


def canonical_hash(data: bytes) -> bytes:
    """XXH3-128, big end first: block hashes."""
    return xxhash.xxh3_128_digest(data)


def raw_hash(data: bytes) -> bytes:
    """XXH3-128 as two little-endian words, low word first: file hashes."""
    return xxhash.xxh3_128_digest(data)[::-1]


def choose_block_size(n: int) -> int:
    import math

    return min(131072, max(2048, -(-math.isqrt(n) // 1024) * 1024))


def choose_strong_len(blocks: int) -> int:
    return 8 if blocks <= 1 << 16 else 12 if blocks <= 1 << 22 else 16


def weak_of(data: bytes) -> int:
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    return (int((x * np.arange(1, len(x) + 1)).sum()) & 0xFFFF) << 16 | int(x.sum()) & 0xFFFF


def rolling_weak(data: bytes, length: int) -> np.ndarray:
    """The weak checksum of every window, from prefix sums (products reduced mod 2^16 first, so they never overflow)."""
    x = np.frombuffer(data, np.uint8).astype(np.int64)
    i = np.arange(1, len(x) + 1) & 0xFFFF
    s = np.concatenate([[0], np.cumsum(x)])
    p = np.concatenate([[0], np.cumsum(x * i)])
    at = np.arange(len(x) - length + 1)
    s1 = s[at + length] - s[at]
    s2 = p[at + length] - p[at] - (at & 0xFFFF) * (s1 & 0xFFFF)
    return (s2 & 0xFFFF) << 16 | s1 & 0xFFFF


def signature(data: bytes, block: int, strong: Callable[[bytes], bytes] = canonical_hash) -> list[tuple[int, int, bytes, int]]:
    """(index, weak, strong, length) of every block; the last may be short."""
    return [(k, weak_of(b), strong(b), len(b)) for k, b in ((at // block, data[at : at + block]) for at in range(0, len(data), block))]


def match(old: bytes, new_size: int, sig: list[tuple[int, int, bytes, int]], block: int, strong: Callable = canonical_hash, strong_len: int = 16, prefix: int | None = None) -> tuple[dict[int, int], dict]:
    """Greedy matching of the new file's full blocks in the old file, left to right: {block: old offset} and statistics.

    At a position, blocks of equal weak sum are tried from the highest index down, each block matches
    once, and a match jumps a whole block. With `prefix`, the scan stops early once the matches so
    far project to too little gain; the plan is then empty. Only positions whose weak sum occurs in
    the signature are visited; the checks in between fall due at the same positions as if all were.
    """
    n, found = len(old), {}
    stats = {"scanned": 0, "matched": 0, "strong": 0, "weak_hits": 0, "stopped": False}
    full = [b for b in sig if b[3] == block]
    if n < block or not full or not new_size:
        return found, stats
    by: dict[int, list[tuple[int, bytes]]] = {}
    for k, weak, digest, _ in reversed(full):
        by.setdefault(weak, []).append((k, digest[:strong_len]))
    weak = rolling_weak(old, block)
    cand = np.flatnonzero(np.isin(weak, np.fromiter(by, np.int64))).tolist()
    last, p, next_eval = n - block, 0, prefix if prefix is not None else None

    def hopeless() -> bool:
        return bool(p) and stats["matched"] * n * 100 <= new_size * 35 * p

    while True:
        at = bisect_left(cand, p)
        c = cand[at] if at < len(cand) else None
        target = last if c is None else c
        while next_eval is not None and p < target and next_eval <= target:
            p = max(p + 1, next_eval)
            if hopeless():
                stats |= {"scanned": p, "stopped": True}
                return {}, stats
            next_eval = p + EARLY_STRIDE
        p = max(p, target)
        if c is None:
            break
        digest, hit = None, None
        for k, want in by[int(weak[p])]:
            stats["weak_hits"] += 1
            if k in found:
                continue
            if digest is None:
                digest = strong(old[p : p + block])[:strong_len]
                stats["strong"] += 1
            if digest == want:
                hit = k
                break
        if hit is not None:
            found[hit] = p
            stats["matched"] += block
            p += block
            if p + block > n:
                break
        else:
            if p + block >= n:
                break
            p += 1
        if next_eval is not None and p >= next_eval:
            if hopeless():
                stats |= {"scanned": p, "stopped": True}
                return {}, stats
            next_eval = p + EARLY_STRIDE
    stats["scanned"] = p
    return found, stats


def plan_ops(found: dict[int, int], new_size: int, block: int) -> list[tuple[str, int | None, int, int]]:
    """(op, old offset, new offset, length): one copy a matched block, one miss a run of unmatched ones."""
    ops: list[tuple[str, int | None, int, int]] = []
    for k in range(-(-new_size // block)):
        at, size = k * block, min(block, new_size - k * block)
        if k in found:
            ops.append(("copy", found[k], at, size))
        elif ops and ops[-1][0] == "miss":
            ops[-1] = ("miss", None, ops[-1][2], ops[-1][3] + size)
        else:
            ops.append(("miss", None, at, size))
    return ops


def rebuild(old: bytes, new_ranges: Callable[[int, int], bytes], ops: list) -> bytes:
    return b"".join(old[src : src + n] if op == "copy" else new_ranges(at, n) for op, src, at, n in ops)


def early_prefix(block: int, old_size: int) -> int:
    """Bytes to scan before the first projection: 256 blocks, a twentieth of the old file or 1 MiB, the most of them, 256 MiB at most."""
    return min(256 << 20, max(1 << 20, block * 256, old_size // 100 * 5 + old_size % 100 * 5 // 100))


def delta_plan(pairs: DataFrame, *, block: int | None = None, prefix: int | None = None, early_stop: bool = True) -> DataFrame:
    """path, old_size, new_size, block, copies, misses, download, matched, scanned, stopped, rejected, verified and fallback of each (path, old, new).

    Files are independent rows, so a plan needs no shuffle; each is rebuilt and its hash compared.
    A scan that projects to too little gain after `prefix` bytes (by default as early_prefix says)
    stops, and the whole file is to be downloaded. fallback names why no delta is used:
    old_unreadable (null), benefit or verify_fail; null if it is.
    """

    def run(frames):
        for f in frames:
            rows = []
            for path, old, new in zip(f["path"], f["old"], f["new"], strict=True):
                unreadable = old is None
                old, new = bytes(old or b""), bytes(new or b"")
                size = block or choose_block_size(len(new))
                sig = signature(new, size)
                found, stats = match(old, len(new), sig, size, strong_len=choose_strong_len(len(sig)), prefix=(prefix or early_prefix(size, len(old))) if early_stop else None)
                ops = plan_ops(found, len(new), size)
                download = sum(o[3] for o in ops if o[0] == "miss")
                built = rebuild(old, lambda a, n, new=new: new[a : a + n], ops)
                rejected, verified = download * 100 >= len(new) * 65, raw_hash(built) == raw_hash(new)
                fallback = "old_unreadable" if unreadable else "benefit" if rejected else None if verified else "verify_fail"
                rows.append((path, len(old), len(new), size, sum(o[0] == "copy" for o in ops), sum(o[0] == "miss" for o in ops), download, stats["matched"], stats["scanned"], stats["stopped"], rejected, verified, fallback))
            yield pd.DataFrame(rows, columns=["path", "old_size", "new_size", "block", "copies", "misses", "download", "matched", "scanned", "stopped", "rejected", "verified", "fallback"])

    schema = "path string, old_size long, new_size long, block long, copies long, misses long, download long, matched long, scanned long, stopped boolean, rejected boolean, verified boolean, fallback string"
    return pairs.select("path", "old", "new").mapInPandas(run, schema)


def weak_sums(data: np.ndarray, block: int) -> np.ndarray:
    """The weak checksum of each block of bytes; the last may be short. All blocks at once."""
    count = -(-len(data) // block)
    x = np.zeros(count * block, np.int64)
    x[: len(data)] = data
    x = x.reshape(count, block)
    return ((x @ np.arange(1, block + 1)) & 0xFFFF) << 16 | x.sum(axis=1) & 0xFFFF


def signatures(files: DataFrame, content: str, *, block: int | None = None, size: str | None = None) -> DataFrame:
    """path, block_index, len, weak, strong, file_hash and error: a row for each block of each file, in one pass over its bytes.

    Without `block`, the block size follows from a file's size. strong is XXH3-128 of the block,
    file_hash the raw hash of the whole file. Files without bytes have no blocks. Null contents give
    one row with error "unreadable", and where `size` names a column and the bytes are not as many,
    one with error "size".
    """
    names = ["path", "block_index", "len", "weak", "strong", "file_hash", "error"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for i, (path, data) in enumerate(zip(batch.column("path").to_pylist(), batch.column(content), strict=True)):
                said = batch.column(size)[i].as_py() if size else None
                raw = data.as_py()
                error = "unreadable" if raw is None else "size" if size and said != len(raw) else None
                if error:
                    for c, x in zip(cols, (path, None, None, None, None, None, error), strict=True):
                        c.append(x)
                    continue
                step = block or choose_block_size(len(raw))
                n = -(-len(raw) // step)
                weak = weak_sums(np.frombuffer(raw, np.uint8), step).tolist()
                for c, x in zip(cols, ([path] * n, range(n), [min(step, len(raw) - k * step) for k in range(n)], weak, [canonical_hash(raw[k * step : (k + 1) * step]) for k in range(n)], [raw_hash(raw)] * n, [None] * n), strict=True):
                    c.extend(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    keep = list(dict.fromkeys(["path", content, *([size] if size else [])]))
    return files.select(*keep).mapInArrow(run, "path string, block_index int, len long, weak long, strong binary, file_hash binary, error string")


def block_weak(files: DataFrame, content: str, block: int) -> DataFrame:
    """path, block_index, len, weak and strong of every block."""
    return signatures(files.filter(F.col(content).isNotNull()), content, block=block).drop("file_hash", "error")


def miss_runs(blocks: DataFrame) -> DataFrame:
    """Runs of consecutive unmatched blocks: path, first block, offset and length, from (path, block_index, offset, len, matched)."""
    from pyspark.sql.window import Window

    missing = blocks.filter(~F.col("matched"))
    island = F.col("block_index") - F.row_number().over(Window.partitionBy("path").orderBy("block_index"))
    return missing.withColumn("island", island).groupBy("path", "island").agg(F.min("block_index").alias("first_block"), F.min("offset").alias("offset"), F.sum("len").alias("len")).drop("island")


def block_matches(old_blocks: DataFrame, new_blocks: DataFrame) -> DataFrame:
    """path, old_index and new_index of old and new blocks with equal lengths, weak and strong sums, as one equal join."""
    side = lambda df, name: df.select("path", "len", "weak", "strong", F.col("block_index").alias(name))
    return side(old_blocks, "old_index").join(side(new_blocks, "new_index"), ["path", "len", "weak", "strong"]).select("path", "old_index", "new_index")

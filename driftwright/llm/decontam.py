"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are the 13-word windows of benchmark items (a shorter item is one window). For
each window length a shift table, indexed by the hash of a block of two words, says how far the
search may jump when a block ends at a position; only where it says 0 are the windows whose last
block hashes alike (the suffix bucket) looked up, and each is then compared word by word and
finally byte by byte. The search runs in numpy over many document segments at once.

Windows are built in bounded chunks on the driver and broadcast; when a benchmark needs several
chunks, the documents pass through one narrow map for each, with no shuffle in between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import ALNUM, Words, mix, pieces
from .common import table, without

WINDOW = 13
#: Words of benchmark text held by one chunk of windows, so by one broadcast (about 110 bytes each).
CHUNK_WORDS = 400_000
SHIFT_BITS = 18
LANE = 1024


def _blocks(words: np.ndarray, b: int) -> np.ndarray:
    """Hash of the block of b words that ends at each position (the first b-1 are unused)."""
    if b == 1 or not len(words):
        return words
    out = words.copy()
    out[1:] = mix(words[:-1] * np.uint64(3) + words[1:])
    return out


class Patterns:
    """Windows of one length with their shift table and suffix buckets."""

    def __init__(self, length: int, rows: np.ndarray, texts: list[bytes], items: list[list[str]]):
        self.length, self.block = length, min(2, length)
        blocks = np.stack([_blocks(r, self.block) for r in rows])
        order = np.argsort(blocks[:, -1], kind="stable")
        self.rows, self.suffix = rows[order], blocks[order, -1]
        self.texts, self.items = [texts[i] for i in order], [items[i] for i in order]
        self.shift = np.full(1 << SHIFT_BITS, length - self.block + 1, np.uint8)
        for j in range(self.block - 1, length):
            np.minimum.at(self.shift, (blocks[:, j] >> np.uint64(64 - SHIFT_BITS)).astype(np.int64), length - 1 - j)

    def find(self, words: Words) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of every occurrence."""
        n = self.length
        blocks = _blocks(words.hash, self.block)
        slot = (blocks >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)
        # Lanes: window ends of each row, cut to segments, searched side by side.
        lo, hi = words.first[:-1] + n - 1, words.first[1:]
        count = np.maximum(0, -(-(hi - lo) // LANE))
        row = np.repeat(np.arange(len(lo)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = lo[row] + step * LANE
        stop = np.minimum(at + LANE, hi[row])
        found = []
        while len(at):
            jump = self.shift[slot[at]]
            zero = jump == 0
            if zero.any():
                found.append(at[zero])
            at = at + np.maximum(jump, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        if not found:
            return
        ends = np.concatenate(found)
        left = np.searchsorted(self.suffix, blocks[ends], side="left")
        width = np.searchsorted(self.suffix, blocks[ends], side="right") - left
        for part in np.array_split(np.arange(len(ends)), max(1, int(width.sum()) // 200_000)):
            e, w = ends[part], width[part]
            end = np.repeat(e, w)
            pattern = np.repeat(left[part] - (np.cumsum(w) - w), w) + np.arange(len(end))
            same = np.ones(len(end), bool)
            for j in range(n):  # word by word, dropping candidates as soon as they differ
                same[same] = words.hash[end[same] - n + 1 + j] == self.rows[pattern[same], j]
            for x, p in zip(end[same] - n + 1, pattern[same], strict=True):
                if words.text(x, x + n) == self.texts[p]:
                    yield int(x), int(p)


def _chunk(rows: list[tuple[str, str]]) -> list[Patterns]:
    words = Words(pa.array([t for _, t in rows], pa.string()), ALNUM)
    by: dict[int, dict[bytes, tuple[np.ndarray, list[str]]]] = {}
    for i, (item, _) in enumerate(rows):
        a, b = int(words.first[i]), int(words.first[i + 1])
        n = min(WINDOW, b - a)
        for s in range(a, b - n + 1) if n else ():
            text = words.text(s, s + n)
            held = by.setdefault(n, {}).setdefault(text, (words.hash[s : s + n], []))[1]
            if item not in held:
                held.append(item)
    return [Patterns(n, np.stack([v[0] for v in x.values()]), list(x), [v[1] for v in x.values()]) for n, x in sorted(by.items())]


def _chunks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[Patterns]]:
    held, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("string"), text_col).toLocalIterator():
        if r[1]:
            held.append((r[0] if r[0] is not None else "null", r[1]))
            size += len(r[1]) // 4 + 1
            if size >= CHUNK_WORDS:
                yield _chunk(held)
                held, size = [], 0
    if held:
        yield _chunk(held)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", benchmark_text: str = "text", percent: int = 5) -> DataFrame:
    """docs with n_words, hits (word ranges covered by a window), item_ids, n_hit and contaminated.

    A null or empty text has no words and is never contaminated. Null items are named "null"; items
    without words match nothing; repeated items count once. An empty benchmark hits nothing. Columns
    of docs that bear a result's name are replaced. Rows are kept one for one, repeated rows too. Texts
    of any length are searched whole; an empty table gives an empty one.
    """
    docs = without(docs, "n_words", "n_hit", "hits", "item_ids", "contaminated")
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<int>"), "item_ids": F.array().cast("array<string>")})
    spark = docs.sparkSession
    chunks = _chunks(benchmark, item_col, benchmark_text)
    for patterns in chain([next(chunks, [])], chunks):  # the driver holds one chunk at a time
        out = out.mapInArrow(_search(spark.sparkContext.broadcast(patterns), text_col), out.schema)
    signed = F.transform("hits", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))  # starts and ends of ranges that do not overlap
    hit = F.aggregate(signed, F.lit(0).cast("long"), lambda n, x: n + x)
    out = out.withColumns({"n_hit": hit, "item_ids": F.array_sort(F.array_distinct("item_ids"))})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(100) * F.col("n_hit") >= F.lit(percent) * F.col("n_words")))


def _search(patterns, text_col: str):
    def search(batches):
        for batch in batches:
            column = batch.column(text_col)
            n_words = np.zeros(batch.num_rows, np.int64)
            hits: list[list[int]] = [[] for _ in range(batch.num_rows)]
            items: list[list[str]] = [[] for _ in range(batch.num_rows)]
            for lo, hi in pieces(column):
                words = Words(column.slice(lo, hi - lo), ALNUM)
                n_words[lo:hi] = np.diff(words.first)
                for p in patterns.value:
                    for x, k in p.find(words):
                        row = int(np.searchsorted(words.first, x, side="right")) - 1
                        first = x - int(words.first[row])
                        hits[lo + row].append((first, first + p.length))
                        items[lo + row].extend(p.items[k])
            old_hits, old_items = batch.column("hits").to_pylist(), batch.column("item_ids").to_pylist()
            merged = [_merge(sorted([*zip(o[::2], o[1::2], strict=True), *h])) for o, h in zip(old_hits, hits, strict=True)]
            put = {
                "n_words": pa.array(n_words, pa.int64()),
                "hits": pa.array(merged, pa.list_(pa.int32())),
                "item_ids": pa.array([sorted({*o, *i}) for o, i in zip(old_items, items, strict=True)], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([put.get(n, batch.column(n)) if n in put else batch.column(n) for n in batch.schema.names], names=batch.schema.names)

    return search


def _merge(ranges: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in ranges:
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated"
    )


def brute_force(docs: list[tuple[object, str | None]], items: list[tuple[object, str | None]]) -> dict:
    """The contract of op3, word by word, for tests."""
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: word.findall((t or "").translate(low))
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = cut(text)
        n = min(WINDOW, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, ids = cut(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if (got := windows.get(tuple(w[s : s + n]))) is not None:
                    hit.update(range(s, s + n))
                    ids |= got
        out[doc] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out



"""Words and word hashes of Arrow string columns, in numpy, without a Python object per word.

A column is taken as one UTF-8 buffer with offsets; words never cross rows. Hashes are 64-bit
polynomial prefix differences with a finalizer, so equal words have equal hashes everywhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = np.uint64(0x9E3779B97F4A7C55)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_tables: dict[str, np.ndarray] = {}

#: Bytes that belong to words: decontamination takes letters, digits and all above ASCII; shingles take all but white space.
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: What a byte counts in a hash: its lower case plus one.
_VALUE = LOWER.astype(np.uint64) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit murmur finalizer."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    t = _tables.get(name)
    if t is None or len(t) < n:
        t = np.full(max(n, 1 << 16), base, np.uint64)
        t[0] = 1
        np.multiply.accumulate(t, out=t)
        _tables[name] = t
    return t[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    base, end = (int(offs[0]), int(offs[-1])) if len(offs) else (0, 0)
    raw = np.frombuffer(data, np.uint8)[base:end] if data is not None and end > base else np.zeros(0, np.uint8)
    return raw, (offs - base if len(offs) else np.zeros(1, np.int64))


def pieces(column: pa.Array, limit: int = 2 << 20):
    """Row ranges (lo, hi) of at most about `limit` bytes of text each; a longer row stands alone."""
    _, offs = buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


class Words:
    """Words of a column: start, end (bytes), hash, and first[i]..first[i+1] the words of row i."""

    def __init__(self, column: pa.Array, is_word: np.ndarray):
        raw, offs = buffers(column)
        self.data = LOWER[raw]
        n = len(raw)
        mask = np.zeros(n + 1, bool)
        mask[:n] = is_word[self.data]
        begins = mask[:n].copy()
        begins[1:] &= ~mask[: n - 1] if n else begins[1:]
        at = offs[:-1][offs[:-1] < n]
        begins[at] = mask[at]
        ends = mask[:n] & ~mask[1:]
        last = offs[1:][offs[1:] > 0] - 1
        ends[last] = mask[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offs)
        prefix = np.zeros(n + 1, np.uint64)
        value = _VALUE[raw]
        value *= _powers("p", _P, n)
        np.cumsum(value, out=prefix[1:])
        self.hash = mix((prefix[self.end] - prefix[self.start]) * _powers("pinv", _PINV, n + 1)[self.start] + (self.end - self.start).astype(np.uint64))

    def text(self, i: int, j: int) -> bytes:
        """Words i..j-1, lower-cased, joined by a space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j], strict=True))


def window_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for j in range(k):
        out = out * _Q + words[j : len(words) - k + 1 + j]
    return mix(out)


def word_hashes(texts: list[str | None], is_word: np.ndarray) -> Words:
    return Words(pa.array(texts, pa.string()), is_word)

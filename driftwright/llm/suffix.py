"""Suffix-array deduplication: removes every byte covered by a long string that a smaller document also holds.

Documents are packed into shards of a few MB. Each shard gets a suffix array by Larsson-Sadakane
refinement (groups that still tie are sorted again by the rank of the suffix a power of two further
on, until LENGTH bytes are told apart) and common prefixes by Kasai's rule (a suffix whose
predecessor moved along with it has one byte less in common), which settles repeats within a shard.
Bytes that no string with a repeated hash covers are left out of the array, as they occur once.

Across shards only sampled suffixes move. Every LENGTH-byte string holds a minimizer: the smallest
hash among its 20-byte substrings, so equal strings anywhere sample equal suffixes. Owners of hash
ranges merge the shards' sorted samples by binary search and tell each shard which of its samples
another shard holds. For those alone a shard sends the bytes around the sample; the owner compares
the strings themselves and answers with the starts that a smaller document also holds. Neither
step ever gathers more than one range of one step in a task. Samples held by very many shards are
dealt by the strings around them instead, so that a passage in all documents is spread as well.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import _P, _PINV, _powers, buffers, mix
from .common import filesystem, new_path, table, trim, written

LENGTH = 50
GRAM = 20
SHARD_BYTES = 2 << 20
#: Samples (8 bytes each) that one owner merges, about, and bytes of contexts that one owner compares, about.
OWNED_BYTES = 4 << 20
#: Contexts that an owner compares at once, about; all of one sample stay together.
BLOCK_ROWS = 1 << 15
#: A sample in more shards than this is dealt by the strings around it.
HOT_SHARDS = 2048
NULL_ID = np.iinfo(np.int64).max


class Shard:
    """Documents of a shard: ids, offsets and bytes."""

    def __init__(self, ids: np.ndarray, offs: np.ndarray, data: np.ndarray):
        self.ids, self.offs, self.data = ids, offs, data

    def dump(self) -> bytes:
        head = np.array([len(self.ids)], np.int64)
        return b"".join(a.tobytes() for a in (head, self.ids, self.offs, self.data))

    @classmethod
    def load(cls, raw: bytes) -> Shard:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        return cls(np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n + 1, 8 + 8 * n), np.frombuffer(raw, np.uint8, -1, 16 + 16 * n))

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        """The ids of the documents that hold positions."""
        return self.ids[np.searchsorted(self.offs, pos, side="right") - 1]

    def open(self, depth: int) -> np.ndarray:
        """Whether each position has at least depth bytes left in its document."""
        ok = np.ones(len(self.data), bool)
        for x, y in zip(np.maximum(self.offs[:-1], self.offs[1:] - depth + 1).tolist(), self.offs[1:].tolist(), strict=True):
            ok[x:y] = False
        return ok

    def left(self, depth: int) -> np.ndarray:
        """Positions with at least depth bytes left in their document."""
        return np.flatnonzero(self.open(depth))


def suffix_groups(s: Shard, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Larsson-Sadakane: positions whose first `length` bytes occur more than once, in suffix order, and their groups.

    Ranks are dense group numbers by depth; groups of one are done and leave the sort.
    """
    n = len(s.data)
    depth = 8
    pos = s.left(depth)
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = s.data
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : n + j]
    key = key[pos]
    rank = np.zeros(n, np.uint32)
    while True:
        order = np.argsort(key)
        key, pos = key[order], pos[order]
        new = np.ones(len(pos), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new, dtype=np.uint32)
        rank[pos] = group
        many = ~(new & np.append(new[1:], True)) if len(pos) else new
        pos, group = pos[many], group[many]
        if depth >= length or not len(pos):
            break
        step = min(depth, length - depth)
        live = s.open(depth + step)[pos]  # suffixes with enough bytes left for the next depth
        pos, group = pos[live], group[live]
        # Positions that left as singletons keep the rank of their depth, which no other position has.
        key = (group.astype(np.uint64) << np.uint64(32)) | rank[pos + step]
        depth += step
    order = np.argsort((group.astype(np.uint64) << np.uint64(32)) | pos.astype(np.uint64))
    return pos[order], group[order]


def common_prefixes(s: Shard, pos: np.ndarray, group: np.ndarray, cap: int) -> np.ndarray:
    """Kasai: bytes that each suffix shares with the one before it in its group (0 for the first), up to cap.

    In text order, a suffix whose predecessor is the next position after the predecessor of the
    position before it shares one byte less; only the others are compared, eight bytes at a time.
    """
    out = np.zeros(len(pos), np.int64)
    if len(pos) < 2:
        return out
    has = np.zeros(len(pos), bool)
    has[1:] = group[1:] == group[:-1]
    at = np.flatnonzero(has)
    by_text = at[np.argsort(pos[at])]
    p, q = pos[by_text], pos[by_text - 1]
    carried = np.zeros(len(p), bool)
    carried[1:] = (p[1:] == p[:-1] + 1) & (q[1:] == q[:-1] + 1)
    end = s.offs[np.searchsorted(s.offs, np.stack([p, q]), side="right")]
    most = np.minimum(end[0] - p, end[1] - q)
    lcp = np.zeros(len(p), np.int64)
    live = np.flatnonzero(~carried)
    run = np.cumsum(~carried) - 1  # the compared suffix that each carried one follows
    limit = np.zeros(len(live), np.int64)
    np.maximum.at(limit, run, np.arange(len(p)) - live[run])
    limit = np.minimum(limit + cap, most[live])  # enough for every suffix that follows
    first = live
    eight = np.ndarray(max(0, len(s.data) - 7), np.uint64, s.data, strides=(1,))  # eight bytes from each position
    todo = np.arange(len(first))
    for width, view, turns in ((8, eight, 16), (1, s.data, 8)):
        more = todo
        for _ in range(turns):
            k = first[more]
            h = lcp[k]
            same = h + width <= limit[more]
            same[same] = view[p[k[same]] + h[same]] == view[q[k[same]] + h[same]]
            more = more[same]
            lcp[first[more]] += width
            if not len(more):
                break
        if width == 8:
            for i in more.tolist():  # a run of many suffixes: by slices
                k, most_i = first[i], int(limit[i])
                while lcp[k] < most_i:
                    h = int(lcp[k])
                    x, y = (s.data[z[k] + h : z[k] + min(most_i, h + (1 << 14))] for z in (p, q))
                    other = x != y
                    at = int(other.argmax())
                    lcp[k] += at if other[at] else len(x)
                    if other[at]:
                        break
    lcp = np.minimum(lcp[first][run] - (np.arange(len(p)) - first[run]), most)
    out[by_text] = np.clip(lcp, 0, cap)
    return out


def _prefix_sums(s: Shard) -> np.ndarray:
    """Sums of all bytes' parts in a polynomial hash before each position."""
    prefix = np.empty(len(s.data) + 1, np.uint64)
    prefix[0] = 0
    part = s.data.astype(np.uint64)
    part += np.uint64(1)
    part *= _powers("p", _P, len(part))
    np.cumsum(part, out=prefix[1:])
    return prefix


def _window_hashes(s: Shard, width: int, prefix: np.ndarray | None = None) -> np.ndarray:
    """Hashes of all strings of `width` bytes, by start, whatever documents they cross."""
    n = len(s.data)
    if n < width:
        return np.zeros(0, np.uint64)
    prefix = _prefix_sums(s) if prefix is None else prefix
    out = prefix[width:] - prefix[:-width]
    out *= _powers("pinv", _PINV, n - width + 1)
    return mix(out)


def _hashes_at(s: Shard, pos: np.ndarray, width: int) -> np.ndarray:
    """Hashes, as of _window_hashes, of the strings of `width` bytes at some positions."""
    if len(pos) * width > 8 * len(s.data):  # so many that all cost less
        return _window_hashes(s, width)[pos]
    h = np.zeros(len(pos), np.uint64)
    for j in range(width - 1, -1, -1):
        h *= _P
        h += s.data[pos + j]
        h += np.uint64(1)
    return mix(h)


def _near(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Indices of hashes that may be wanted: a table of leading bits passes few others on to a search."""
    seen = np.zeros(1 << 20, bool)
    seen[(wanted >> np.uint64(44)).astype(np.int64)] = True
    return np.flatnonzero(seen[(hashes >> np.uint64(44)).astype(np.int64)])


def _found(hashes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Whether each hash is among the sorted wanted ones."""
    if not len(wanted):
        return np.zeros(len(hashes), bool)
    return wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes


def repeating_part(s: Shard, length: int, prefix: np.ndarray | None = None) -> tuple[Shard, np.ndarray, np.ndarray]:
    """The bytes that strings of `length` bytes with equal hashes cover, each run of them as a document; where they lie in s; those strings' starts.

    Strings that are left out have a hash of their own, so they occur once; those that stay are told
    apart by their bytes.
    """
    pos = s.left(length)
    hashes = _window_hashes(s, length, prefix)[pos] if len(pos) else np.zeros(0, np.uint64)
    ordered = np.sort(hashes)
    many = ordered[1:][ordered[1:] == ordered[:-1]]
    near = _near(hashes, many)
    twice = pos[near[_found(hashes[near], many)]]
    edge = np.zeros(len(s.data) + 1, np.int32)
    edge[twice] += 1
    edge[twice + length] -= 1  # twice holds each position once
    at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    doc = np.searchsorted(s.offs, at, side="right") - 1
    first = np.flatnonzero((np.diff(at, prepend=-2) > 1) | (np.diff(doc, prepend=-1) > 0))
    return Shard(s.ids[doc[first]], np.append(first, len(at)), s.data[at]), at, twice


def repeats_within(s: Shard, length: int, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Whether the string of `length` bytes that starts at each position also starts in a smaller document of the shard, and whether its hash repeats there at all."""
    covered = np.zeros(len(s.data), bool)
    part, at, twice = repeating_part(s, length, prefix)
    again = np.zeros(len(s.data), bool)
    again[twice] = True
    pos, group = suffix_groups(part, length)
    if len(pos):
        first = common_prefixes(part, pos, group, length) < length
        starts = np.flatnonzero(first)
        ids = part.doc_of(pos)
        least = np.minimum.reduceat(ids, starts)
        covered[at[pos]] = ids > least[np.cumsum(first) - 1]
    return covered, again


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over every `width` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = op(x[: len(x) - step], x[step:])
        done += step
    return x


def samples(s: Shard, wanted: np.ndarray, length: int, gram: int = GRAM, prefix: np.ndarray | None = None) -> np.ndarray:
    """Positions of the minimizers of all wanted strings (flags by start): the places of the least 31 bits of a substring's hash, ties included."""
    n, width = len(s.data), length - gram + 1
    if n < length:
        return np.zeros(0, np.int64)
    hashes = (_window_hashes(s, gram, prefix) >> np.uint64(33)).astype(np.uint32)
    hashes += np.uint32(1)
    least = _slide(hashes, width, np.minimum)  # of each string, by start
    least[~wanted[: len(least)]] = 0  # less than any hash
    # A position is sampled if some wanted string that holds it has its hash as the least.
    edge = np.zeros(width - 1, np.uint32)
    top = _slide(np.concatenate([edge, least, edge]), width, np.maximum)
    return np.flatnonzero(top == hashes)


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def _cut(bucket: np.ndarray):
    """(bucket, from, to) of each run of equal, sorted buckets."""
    if not len(bucket):
        return ()
    edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    return zip(bucket[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(bucket)], strict=True)


_MESSAGE = "bucket long, shard string, data binary"


def _message(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["bucket", "shard", "data"])


class _Store:
    """Files of a folder in the shared store, compressed; each name is written whole and only once per attempt."""

    def __init__(self, folder: str):
        self.store, self.root = filesystem(folder)

    def put(self, name: str, raw: bytes) -> None:
        with self.store.open_output_stream(f"{self.root}/{name}", compression="zstd") as f:
            f.write(raw)

    def get(self, name: str) -> bytes:
        with self.store.open_input_stream(f"{self.root}/{name}", compression="zstd") as f:
            return f.read()

    def shard(self, name: str) -> Shard:
        return Shard.load(self.get(name))

    def flags(self, name: str, what: str, s: Shard) -> np.ndarray:
        """A flag for each position of a shard."""
        return np.unpackbits(np.frombuffer(self.get(f"{name}.{what}"), np.uint8), count=len(s.data)).view(bool)

    def samples(self, name: str, s: Shard) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of a shard's samples."""
        pos = np.flatnonzero(self.flags(name, "sampled", s))
        return pos, _hashes_at(s, pos, GRAM)


def make_shards(docs: DataFrame, id_col: str, text_col: str, length: int, shard_bytes: int) -> tuple[str, DataFrame]:
    """The folder of shards and their manifest (shard, bytes). Every attempt names its shards anew; the manifest lists those that count."""
    folder = new_path(docs.sparkSession, "suffix")

    def run(batches):
        files = _Store(folder)
        files.store.create_dir(files.root, recursive=True)
        ids, texts, size = [], [], 0

        def close():
            name = uuid.uuid4().hex
            offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            s = Shard(np.concatenate(ids), offs, np.frombuffer(b"".join(texts), np.uint8))
            files.put(name, s.dump())
            prefix, sampled = _prefix_sums(s), np.zeros(len(s.data), bool)
            covered, again = repeats_within(s, length, prefix)
            sampled[samples(s, s.open(length) & ~covered, length, prefix=prefix)] = True
            for what, flags in (("within", covered), ("again", again & ~covered), ("sampled", sampled)):
                files.put(f"{name}.{what}", np.packbits(flags).tobytes())
            del prefix, covered, again, sampled, flags
            trim()
            return pa.RecordBatch.from_pydict({"shard": [name], "bytes": pa.array([len(s.data)], pa.int64())})

        for batch in batches:
            raw, offs = buffers(batch.column(text_col))
            keys = batch.column(id_col).cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            for i in range(len(keys)):
                if texts and size + offs[i + 1] - offs[i] > shard_bytes:
                    yield close()
                    ids, texts, size = [], [], 0
                ids.append(keys[i : i + 1])
                texts.append(raw[offs[i] : offs[i + 1]].tobytes())
                size += len(texts[-1])
        if texts:
            yield close()

    made = docs.select(id_col, text_col).mapInArrow(run, "shard string, bytes long")
    return folder, written(made, "suffix-manifest")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES, owned_bytes: int = OWNED_BYTES, hot_shards: int = HOT_SHARDS, with_text: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, spans (byte ranges removed), kept_sha256 and, with_text, kept (bytes) of every row.

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller
    id. Null texts are empty; null ids count as larger than all; rows with equal ids don't affect
    each other; texts shorter than `length` stay. Other columns of docs are not carried along.
    """
    folder, manifest = make_shards(docs, id_col, text_col, length, shard_bytes)
    shards, total = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).collect()[0]
    tasks = max(1, min(shards, 20_000))
    owners = max(1, total * 2 * 8 // (length - GRAM + 2) // owned_bytes)
    list_ = manifest.select("shard").repartition(tasks)
    # For a context, the strings in it that a smaller document holds too, as bits.
    answer = np.dtype([("pos", np.int64), ("mask", np.uint64, ((length - GRAM) // 64 + 1,))])

    def sample(batches):
        files = _Store(folder)
        for batch in batches:
            for name in batch.column("shard").to_pylist():
                hashes = np.unique(files.samples(name, files.shard(name))[1])
                out = _message([(b, name, hashes[x:y].tobytes()) for b, x, y in _cut(_ranges(hashes, owners))])
                del hashes
                trim()
                yield out

    def merge(got: pa.Table) -> pa.Table:
        """The samples of one range that two shards or more hold, back to the shards that hold them."""
        lists = [np.frombuffer(d, np.uint64) for d in got.column("data").to_pylist()]
        both = np.sort(np.concatenate(lists))
        first = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
        count = np.diff(np.append(first, len(both)))
        held, hot = both[first][count > 1], count[count > 1] > hot_shards
        rows = []
        for name, own in zip(got.column("shard").to_pylist(), lists, strict=True):
            at = np.searchsorted(own, held)  # both are in order: the merge is a binary search
            mine = at < len(own)
            mine[mine] = own[at[mine]] == held[mine]
            if mine.any():
                rows.append((0, name, np.stack([held[mine], hot[mine].astype(np.uint64)]).tobytes()))
        return pa.Table.from_batches([_message(rows)])

    def contexts(got: pa.Table) -> pa.Table:
        """For each sample that another shard holds, the bytes around it: of equal contexts one, of the smallest document."""
        name = got.column("shard")[0].as_py()
        files = _Store(folder)
        s = files.shard(name)
        held = np.concatenate([np.frombuffer(d, np.uint64).reshape(2, -1) for d in got.column("data").to_pylist()], axis=1)
        held = held[:, np.argsort(held[0])]
        pos, hashes = files.samples(name, s)
        at = np.minimum(np.searchsorted(held[0], hashes), held.shape[1] - 1)
        shared = held[0][at] == hashes
        pos, hashes, hot = pos[shared], hashes[shared], held[1][at[shared]].astype(bool)
        cold, cold_hash = _distinct(s, pos[~hot], hashes[~hot], length - GRAM, 2 * length - GRAM)
        rows = _pack(name, cold, _ranges(cold_hash, owners), 0)
        if hot.any():  # each string on its own, dealt by its hash
            starts = np.unique((pos[hot][:, None] - np.arange(length - GRAM + 1)).ravel())
            starts = starts[(starts >= 0)]
            starts = starts[(s.open(length) & ~files.flags(name, "within", s))[starts]]
            each, _ = _distinct(s, starts, starts, 0, length)
            rows += _pack(name, each, _ranges(mix(_row_hash(each["bytes"], 0, length)), owners), owners)
        return pa.Table.from_batches([_message(rows)])

    def compare(got: pa.Table) -> pa.Table:
        """Which strings of each context a smaller document holds too, back to their shards."""
        width = length if got.column("bucket")[0].as_py() >= owners else 2 * length - GRAM
        kind = _kind(width)
        names, packed = got.column("shard").to_pylist(), [d.as_buffer() for d in got.column("data")]
        sizes = [int.from_bytes(d[:8].to_pybytes(), "little") // kind.itemsize for d in packed]
        rows, shard = np.empty(sum(sizes), kind), np.repeat(np.arange(len(sizes)), sizes)
        for d, x, n in zip(packed, np.cumsum(sizes) - sizes, sizes, strict=True):
            rows[x : x + n] = np.frombuffer(pa.decompress(d[8:], n * kind.itemsize, "zstd"), kind)
        late_at = np.zeros((len(rows), (length - GRAM) // 64 + 1), np.uint64)
        # Strings can only be equal if their samples are (width - length bytes in): blocks of whole samples.
        sample_at = width - length
        sample = _row_hash(rows["bytes"], sample_at, GRAM if sample_at else length)
        order = np.argsort(sample)
        edge = np.flatnonzero(np.append(True, sample[order][1:] != sample[order][:-1])) if len(order) else order
        for block in np.split(order, edge[1:][np.diff(edge // BLOCK_ROWS) > 0]):
            part, h = rows[block], None
            for start in range(sample_at + 1):  # the strings that hold the sample, from left to right
                h = _row_hash(part["bytes"], 0, length) if h is None else _roll(h, part["bytes"], start, length)
                ok = np.flatnonzero((part["from"] <= start) & (part["to"] >= start + length))
                least = _least_ids(h[ok], part["bytes"][ok, start : start + length], part["id"][ok])
                late_at[block[ok[part["id"][ok] > least]], start // 64] |= np.uint64(1 << start % 64)
        some = np.flatnonzero(late_at.any(axis=1))  # in order of shards
        made = np.empty(len(some), answer)
        made["pos"], made["mask"] = rows["pos"][some], late_at[some]
        return pa.Table.from_batches([_message([(0, names[b], made[x:y].tobytes()) for b, x, y in _cut(shard[some])])])

    def finish(got: pa.Table) -> pa.Table:
        name = got.column("shard")[0].as_py()
        files = _Store(folder)
        s = files.shard(name)
        covered = files.flags(name, "within", s)
        crossed = np.zeros(len(s.data), bool)
        for d in got.column("data").to_pylist():
            said = np.frombuffer(d, answer)
            for start in range(length - GRAM + 1):
                late = (said["mask"][:, start // 64] >> np.uint64(start % 64)) & np.uint64(1) > 0
                crossed[said["pos"][late] + start] = True
        covered |= crossed
        found = np.flatnonzero(crossed)
        if len(found):
            spread(s, covered, found, files.flags(name, "again", s), length)
        edge = np.zeros(len(s.data) + 1, np.int32)
        starts = np.flatnonzero(covered)
        edge[starts] += 1
        edge[starts + length] -= 1  # starts holds each position once
        gone = np.cumsum(edge[:-1]) > 0
        cols: dict[str, list] = {n: [] for n in ("id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept")}
        for key, a, b in zip(s.ids.tolist(), s.offs[:-1].tolist(), s.offs[1:].tolist(), strict=True):
            out = gone[a:b]
            turn = np.flatnonzero(np.diff(np.concatenate([[0], out.view(np.int8), [0]])))
            kept = s.data[a:b][~out].tobytes() if len(turn) else s.data[a:b].tobytes()
            cols["id"].append(None if key == NULL_ID else key)
            cols["n_bytes"].append(b - a)
            cols["n_removed"].append(b - a - len(kept))
            cols["spans"].append([{"start": x, "end": y} for x, y in turn.reshape(-1, 2).tolist()])
            cols["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            cols["kept"].append(kept if with_text else None)
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), span, pa.string(), pa.binary())
        return pa.table({n: pa.array(cols[n], k) for n, k in zip(cols, kinds, strict=True)})

    def by(df: DataFrame, key: str, n: int):
        return df.repartition(max(1, min(n, 20_000)), key).groupBy(key)

    def lean(step):
        def run(got: pa.Table) -> pa.Table:
            trim()  # what the group before has left
            return step(got)

        return run

    sampled = list_.mapInArrow(sample, _MESSAGE)
    held = by(sampled, "bucket", owners).applyInArrow(lean(merge), _MESSAGE)
    around = by(held, "shard", tasks).applyInArrow(lean(contexts), _MESSAGE)
    starts = by(around, "bucket", owners).applyInArrow(lean(compare), _MESSAGE)
    every = starts.select("shard", "data").unionByName(manifest.select("shard", F.lit(b"").alias("data")))
    result = by(every, "shard", tasks).applyInArrow(lean(finish), "id long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string, kept binary")
    result = result.withColumnRenamed("id", id_col)
    return result if with_text else result.drop("kept")


def _kind(width: int) -> np.dtype:
    return np.dtype([("bytes", np.uint8, (width,)), ("from", np.uint8), ("to", np.uint8), ("id", np.int64), ("pos", np.int64)])


def _records(s: Shard, pos: np.ndarray, before: int, width: int) -> np.ndarray:
    """For each position the `width` bytes from `before` bytes ahead of it, blank outside its document; pos is where they start."""
    doc = np.searchsorted(s.offs, pos, side="right") - 1
    out = np.zeros(len(pos), _kind(width))
    begin = pos - before
    out["from"] = np.clip(s.offs[doc] - begin, 0, width)
    out["to"] = np.clip(s.offs[doc + 1] - begin, 0, width)
    out["id"], out["pos"] = s.ids[doc], begin
    if len(pos):
        for j in range(width):
            at = begin + j
            inside = (j >= out["from"]) & (j < out["to"])
            out["bytes"][:, j] = np.where(inside, s.data[np.clip(at, 0, len(s.data) - 1)], 0)
    return out


def _row_hash(rows: np.ndarray, start: int, length: int) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for j in range(length - 1, -1, -1):
        h = h * _P + rows[:, start + j]
    return h


def _roll(h: np.ndarray, rows: np.ndarray, start: int, length: int) -> np.ndarray:
    """Hashes of the strings from `start`, from those one byte before."""
    top = np.uint64(pow(int(_P), length - 1, 1 << 64))
    return (h - rows[:, start - 1]) * _PINV + rows[:, start + length - 1] * top


def _least_ids(h: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the smallest id among rows with equal bytes; hashes only find them, bytes decide."""
    if not len(h):
        return ids
    order = np.argsort(h)
    new = np.append(True, h[order][1:] != h[order][:-1])
    group = np.cumsum(new) - 1
    lead = order[np.flatnonzero(new)]
    if (rows[order] != rows[lead][group]).any():  # two strings with one hash
        _, group = np.unique(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), return_inverse=True)
        least = np.full(group.max() + 1, NULL_ID)
        np.minimum.at(least, group, ids)
        return least[group]
    out = np.empty_like(ids)
    out[order] = np.minimum.reduceat(ids[order], np.flatnonzero(new))[group]
    return out


def _distinct(s: Shard, pos: np.ndarray, keys: np.ndarray, before: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """One record, of the smallest document, of each different context, and its key. A text that repeats itself has few contexts, however long."""
    made, held = np.zeros(0, _kind(width)), keys[:0]
    for at in range(0, len(pos), BLOCK_ROWS):
        made = np.concatenate([made, _records(s, pos[at : at + BLOCK_ROWS], before, width)])
        held = np.concatenate([held, keys[at : at + BLOCK_ROWS]])
        h = _row_hash(made["bytes"], 0, width) + (made["from"].astype(np.uint64) << np.uint64(8)) + made["to"]
        order = np.lexsort((made["pos"], made["id"], h))
        made, held, h = made[order], held[order], h[order]
        same = np.append(False, h[1:] == h[:-1])
        same[1:] &= (made["bytes"][1:] == made["bytes"][:-1]).all(axis=1) & (made["from"][1:] == made["from"][:-1]) & (made["to"][1:] == made["to"][:-1])
        made, held = made[~same], held[~same]
    return made, held


def spread(s: Shard, covered: np.ndarray, starts: np.ndarray, again: np.ndarray, length: int) -> None:
    """Covers the strings of a shard that equal those at starts, in documents that are no smaller. again: starts whose hash repeats in the shard."""
    starts = starts[again[starts]]
    if not len(starts):
        return
    key, ids = _hashes_at(s, starts, length), s.doc_of(starts)
    order = np.lexsort((ids, key))
    lead, key, ids = starts[order], key[order], ids[order]
    pos = np.flatnonzero(again & ~covered)
    hashes = _hashes_at(s, pos, length)
    near = _near(hashes, key)
    pos, hashes = pos[near], hashes[near]
    at = np.searchsorted(key, hashes)
    while len(pos):  # one turn, but for different strings with one hash
        live = at < len(key)
        live[live] = key[at[live]] == hashes[live]
        pos, at, hashes = pos[live], at[live], hashes[live]
        equal = np.ones(len(pos), bool)
        for j in range(length):
            equal &= s.data[pos + j] == s.data[lead[at] + j]
        covered[pos[equal & (s.doc_of(pos) >= ids[at])]] = True
        pos, at, hashes = pos[~equal], at[~equal] + 1, hashes[~equal]


def _pack(name: str, rows: np.ndarray, bucket: np.ndarray, add: int) -> list[tuple]:
    """Messages of records by bucket."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    out = []
    for b, x, y in _cut(bucket):
        raw = rows[x:y].tobytes()
        out.append((b + add, name, len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)))
    return out


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicate(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def brute_force(docs: list[tuple[int | None, str | None]], length: int = LENGTH) -> list[tuple]:
    """The contract of op4 for tests: (id, bytes, removed, spans, sha256) of each row."""
    least: dict[bytes, float] = {}
    raws = [(float("inf") if d is None else d, (t or "").encode()) for d, t in docs]
    for d, raw in raws:
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            least[w] = min(d, least.get(w, float("inf")))
    out = []
    for (d, raw), (key, _) in zip(raws, docs, strict=True):
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if least[raw[p : p + length]] < d:
                gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out

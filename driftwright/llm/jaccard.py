"""Near duplicates: an exact Jaccard self-join of shingle sets with count-vector R-trees.

A document's set holds its distinct 5-word shingles, hashed to 64 bits; equal sets are one node.
The points of the index are count vectors: shingles are hashed into groups and counted, and the sum
of coordinate minima bounds the overlap of two sets from above.

The points are partitioned into cells, each with an R-tree of its own: by the prefix principle two
sets with similarity t share one of the first n - ceil(t n) + 1 shingles in any common order. The
order is by hash, with shingles that are very frequent in the whole corpus last, so common passages
do not gather documents. Shingles with the same nodes share one cell. (One tree over all points
prunes next to nothing: counts of unrelated long texts in few groups are alike.) A point has as many
coordinates as its size class asks for; neighbouring classes meet on the coarser one.

Each cell first pairs its nodes with leaders of its own: the first by hash, and the one nearest to
the cell's mean point, which in a group of edited copies is the least edited. Verified pairs are
contracted to components. Then the trees find for every node the partner of highest bound in
another component, and these pairs are verified and contracted. Last, the trees find all pairs
between components that are left whose bound reaches the threshold. Pairs are bounded once more
with finer vectors and verified on the whole sets, so no link between components is lost, and a
group of thousands of copies costs a few stars, not a square. A cell of more than SPLIT nodes is
dealt into blocks, and each two blocks are joined in a task of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewords import NONSPACE, Words, buffers, mix, pieces, window_hash
from .common import arrow_rows, discard, release, table, written

WORDS = 5
#: Similarity as a fraction: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Coordinates of a count vector of a set of SMALL shingles or fewer; each doubling of the size doubles them, so that four shingles at most share a group.
DIMS, SMALL = 128, 512
#: A shingle in this share of all documents, and in 64 at least, comes last in the order; so few shingles are that frequent that their list stays bounded.
FREQUENT, FREQUENT_LEAST = 0.0005, 64
#: The filter of candidate nodes that the second reading of the texts uses is a bit map of this size at most.
FILTER_BITS = 1 << 26
#: Frequent shingles that the driver holds at most, the most frequent of all (8 bytes each).
MOST_FREQUENT = 1 << 20
LEAF = 16
#: Nodes of a cell, about, from which it is dealt into blocks of as many; leaves that are searched for at once; coordinates that are compared at once.
SPLIT = 8192
QUERY_LEAVES = 64
BLOCK_CELLS = 1 << 22
#: Bytes of cells that are searched at once, about, and rows of an Arrow batch that holds whole sets.
RUN_BYTES = 8 << 20
SET_ROWS = 256
#: Pairs that a task holds before it passes them on (24 bytes each), and rows of a family's cells that one task gets, about.
PAIRS_OUT, FAMILY_ROWS = 1 << 20, 1 << 16


#: Bytes of text that are turned into sets at once, so that the arrays stay in the cache; a longer text stands alone.
PIECE = 1 << 18


class Sets:
    """Shingle sets of rows: `items` has the sorted distinct hashes of row i at at[i]..at[i+1]; fewer words than k make one shingle."""

    def __init__(self, words: Words, k: int = WORDS):
        first, h = words.first, words.hash
        many = np.diff(first)
        number = np.where(many > 0, np.maximum(1, many - k + 1), 0)
        at = np.append(0, np.cumsum(number))
        items = np.zeros(at[-1], np.uint64)
        whole = window_hash(h, k)
        inside = np.repeat(first[:-1] - at[:-1], number) + np.arange(len(items))  # the first word of every shingle
        long = np.repeat(many >= k, number)
        items[long] = whole[inside[long]]
        for r in np.flatnonzero((many > 0) & (many < k)).tolist():
            items[at[r]] = window_hash(h[first[r] : first[r + 1]], int(many[r]))[0]
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            items[x:y].sort()
        keep = np.append(True, items[1:] != items[:-1])[: len(items)]
        keep[at[:-1][number > 0]] = True
        self.items, self.at = items[keep], np.append(0, np.cumsum(keep))[at]
        self.n = np.diff(self.at)
        self.row = np.repeat(np.arange(len(self.n)), self.n)

    def signatures(self) -> np.ndarray:
        """A 64-bit hash of each set; with its size it names the node. Of no meaning where n is 0."""
        each = np.append(np.uint64(0), np.cumsum(mix(self.items ^ np.uint64(0x5851F42D4C957F2D))))
        return mix(each[self.at[1:]] - each[self.at[:-1]] + self.n.astype(np.uint64)).view(np.int64)

    def groups(self) -> np.ndarray:
        """The hash that deals shingles into groups."""
        return (mix(self.items) >> np.uint64(40)).astype(np.int64)

    def _counts(self, groups: np.ndarray, dims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the shingles in dims groups of each row (a power of two), up to `most`, end to end, and where each row begins."""
        base = np.append(0, np.cumsum(dims))
        return np.minimum(np.bincount(base[self.row] + (groups & (dims[self.row] - 1)), minlength=base[-1]), most).astype(np.uint8), base

    def packed(self, groups: np.ndarray) -> pa.Array:
        """The points of the index: coordinates of 4 bits, of which 15 stands for the whole size."""
        c, base = self._counts(groups, DIMS << size_class(self.n), 15)
        return _binary(c[::2] << 4 | c[1::2], base // 2)

    def fine(self, groups: np.ndarray) -> pa.Array:
        """Finer count vectors: twice the coordinates, of 8 bits. Vectors of different lengths fold onto the shorter."""
        return _binary(*self._counts(groups, 2 * DIMS << size_class(self.n), 255))

    def prefixes(self, last: np.ndarray, percent: int) -> pa.Array:
        """The first n - ceil(percent n) + 1 shingles of each set, by hash, those in `last` behind all others."""
        late = np.zeros(len(self.items), bool)
        if len(last):
            late = last[np.minimum(np.searchsorted(last, self.items), len(last) - 1)] == self.items
        before = np.append(0, np.cumsum(late))
        mine = before[:-1] - before[self.at[:-1]][self.row]  # late ones before it in its row
        early = self.n - np.diff(before[self.at])
        place = np.where(late, early[self.row] + mine, np.arange(len(late)) - self.at[:-1][self.row] - mine)
        keep = place < (self.n - -(-percent * self.n // 100) + 1)[self.row]
        offsets = np.append(0, np.cumsum(keep))[self.at]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.items[keep].view(np.int64)))


def size_class(n: np.ndarray) -> np.ndarray:
    """How often the coordinates of a set of n are doubled."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(1, n) / SMALL))).astype(np.int64)


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def overlap_needed(n: np.ndarray, m: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The least intersection of sets of n and m: 100 i >= p (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def fine_bounds(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Upper bounds of the overlaps of pairs of sets from their finer vectors. Rows with vectors of the same two lengths are bounded together."""
    out = np.zeros(len(x), np.int64)
    (a, a_at), (b, b_at) = buffers(x), buffers(y)
    long = np.stack([np.diff(a_at), np.diff(b_at)], axis=1)
    for p, q in np.unique(long, axis=0).tolist():
        rows, dims = np.flatnonzero((long == (p, q)).all(axis=1)), min(p, q)
        for some in np.array_split(rows, 1 + len(rows) * (p + q) // (1 << 20)):
            u, v = (w[at[some][:, None] + np.arange(n)] for w, at, n in ((a, a_at, p), (b, b_at, q)))
            full = (u == 255).any(axis=1) | (v == 255).any(axis=1)  # a count that did not fit
            u, v = (w.reshape(len(some), -1, dims).sum(axis=1, dtype=np.int64) for w in (u, v))
            out[some] = np.where(full, 1 << 62, np.minimum(u, v).sum(axis=1))
    return out


class Points:
    """The points of nodes: an array of coordinates, no smaller than the counts, for each size class; `at` is a node's row in it.

    Sets that can be similar are of one class or of neighbours; then the larger one's point is folded.
    """

    def __init__(self, n: np.ndarray, vec: list[bytes]):
        self.n, self.cls, self.at = n, size_class(n), np.zeros(len(n), np.int64)
        self.mat, self.rows = {}, {}
        for k in np.unique(self.cls).tolist():
            rows = np.flatnonzero(self.cls == k)
            q = np.frombuffer(b"".join([vec[i] for i in rows.tolist()]), np.uint8).reshape(len(rows), -1)
            q = np.stack([q >> 4, q & 15], axis=2).reshape(len(rows), -1)
            out = q.astype(np.uint16 if n[rows].max() < 1 << 16 else np.int64)
            row, at = np.nonzero(q == 15)
            out[row, at] = n[rows[row]]
            self.mat[k], self.rows[k], self.at[rows] = out, rows, np.arange(len(rows))

    def folded(self, rows: np.ndarray, k: int) -> np.ndarray:
        """Points of rows of class k or k + 1 with the coordinates of class k."""
        same = self.cls[rows] == k
        out = np.zeros((len(rows), DIMS << k), np.int64)
        for c, some in ((k, same), (k + 1, ~same)):
            if some.any():
                out[some] = self.mat[c][self.at[rows[some]]].reshape(some.sum(), -1, DIMS << k).sum(axis=1)
        return out

    def bound(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Upper bounds of the overlaps of pairs of one class or of neighbours; others get none."""
        out = np.zeros(len(i), np.int64)
        low, high = np.minimum(self.cls[i], self.cls[j]), np.maximum(self.cls[i], self.cls[j])
        for k in np.unique(low).tolist():
            pairs = np.flatnonzero((low == k) & (high == k))
            for s in _blocks(len(pairs), DIMS << k):
                out[pairs[s]] = _bound(self.mat[k], self.at[i[pairs[s]]], self.at[j[pairs[s]]])
            pairs = np.flatnonzero((low == k) & (high == k + 1))
            for s in _blocks(len(pairs), 4 * DIMS << k):
                out[pairs[s]] = np.minimum(self.folded(i[pairs[s]], k), self.folded(j[pairs[s]], k)).sum(axis=1)
        return out


def _bound(p: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.minimum(p[i], p[j]).sum(axis=1, dtype=np.int64)


def tree_join(n: np.ndarray, p: np.ndarray, label: np.ndarray, percent: int = PERCENT, side: np.ndarray | None = None):
    """Arrays (i, j, bound) of index pairs with different labels whose bound reaches the threshold, by joining an R-tree with itself; with side, the points of side 0 with a tree of those of side 1.

    A tree is packed by tiles: sorted by size, then by the coordinate that varies most, in leaves of
    LEAF. A leaf is joined with a box of the tree only if the sum of the minima of their upper
    corners reaches the overlap that their least sizes need, their size ranges are close enough and
    they hold more than one label. Each unordered pair comes once.
    """
    order = np.lexsort((p[:, int(p.var(axis=0).argmax())], n))
    one = np.arange(LEAF)

    def packed(at):
        levels, box = [], (p[at], n[at], n[at], label[at], label[at])
        while not levels or len(box[0]) > 1:
            cut = np.arange(0, len(box[0]), LEAF)
            box = tuple(f.reduceat(x, cut) for f, x in zip((np.maximum, np.minimum, np.maximum, np.minimum, np.maximum), box, strict=True))
            levels.append(box)
        return levels

    mine = order if side is None else order[side[order] == 0]
    theirs = order if side is None else order[side[order] == 1]
    if not len(mine) or not len(theirs):
        return
    levels = packed(theirs)
    top, lo, hi, l_lo, l_hi = levels[0] if side is None else packed(mine)[0]
    for x in range(0, len(lo), QUERY_LEAVES):
        a = np.arange(x, min(len(lo), x + QUERY_LEAVES))
        b = np.zeros(len(a), np.int64)
        for depth in range(len(levels) - 1, -1, -1):
            b_top, b_lo, b_hi, b_l_lo, b_l_hi = levels[depth]
            if depth < len(levels) - 1:
                a, b = np.repeat(a, LEAF), (b[:, None] * LEAF + one).ravel()
                ok = b < len(b_lo)
                if side is None:
                    ok &= (b + 1) * LEAF**depth > a  # not the leaves before the query's own
                a, b = a[ok], b[ok]
            keep = (100 * hi[a] >= percent * b_lo[b]) & (100 * b_hi[b] >= percent * lo[a]) & (np.minimum(l_lo[a], b_l_lo[b]) != np.maximum(l_hi[a], b_l_hi[b]))
            a, b = a[keep], b[keep]
            keep = [np.minimum(top[a[s]], b_top[b[s]]).sum(axis=1, dtype=np.int64) >= overlap_needed(lo[a[s]], b_lo[b[s]], percent) for s in _blocks(len(a), p.shape[1])]
            keep = np.concatenate(keep) if keep else np.zeros(0, bool)
            a, b = a[keep], b[keep]
        for s in _blocks(len(a), LEAF * LEAF * p.shape[1]):
            i = np.repeat(a[s, None] * LEAF + one, LEAF, axis=1).ravel()
            j = np.tile(b[s, None] * LEAF + one, (1, LEAF)).ravel()
            ok = (i < len(mine)) & (j < len(theirs))
            if side is None:
                ok &= i < j
            i, j = mine[i[ok]], theirs[j[ok]]
            near = (label[i] != label[j]) & (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i])
            i, j = i[near], j[near]
            bound = _bound(p, i, j)
            near = bound >= overlap_needed(n[i], n[j], percent)
            if near.any():
                yield i[near], j[near], bound[near]


def _blocks(n: int, weight: int = 1):
    """Slices that cover n, each of BLOCK_CELLS coordinates or so if one place needs `weight` of them."""
    step = max(1, BLOCK_CELLS // weight)
    return [slice(x, min(n, x + step)) for x in range(0, n, step)]


def _sets(column):
    """(first row, Sets) of the rows of a column, a bounded piece at a time."""
    for lo, hi in pieces(column, PIECE):
        yield lo, Sets(Words(column.slice(lo, hi - lo), NONSPACE))


def frequent(docs: DataFrame, text_col: str) -> np.ndarray:
    """Hashes of the most frequent shingles, sorted. Counted over all documents; only shingles that occur 8 times or more in some 16 MB of a task's text are counted up, which bears on the order, not on the result."""

    def run(batches):
        held, size = [], 0

        def flush():
            h = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            n = np.diff(np.append(at, len(h)))
            return pa.RecordBatch.from_pydict({"h": pa.array(h[at[n >= 8]].view(np.int64)), "n": pa.array(n[n >= 8].astype(np.int64))})

        for batch in batches:
            for _, s in _sets(batch.column(text_col)):
                held.append(s.items)
                size += len(s.items)
                if size >= 3_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    total = docs.count()
    found = docs.select(text_col).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = found.filter(F.col("n") >= max(FREQUENT_LEAST, int(total * FREQUENT))).orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).select("h").toArrow()
    return np.sort(rows.column("h").to_numpy().view(np.uint64))


def sets(docs: DataFrame, id_col: str, text_col: str, last: np.ndarray, percent: int) -> DataFrame:
    """id, n, sig, the count vectors and tokens (the prefix) of every row; sig and vectors are null without words."""
    order = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        for batch in batches:
            ids = batch.column(id_col).cast(pa.int64())
            for lo, s in _sets(batch.column(text_col)):
                none, groups = pa.array(s.n == 0), s.groups()
                cols = [pa.array(s.signatures()), s.packed(groups), s.fine(groups)]
                cols = [pc.if_else(none, pa.scalar(None, c.type), c) for c in cols]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, len(s.n)), pa.array(s.n, pa.int64()), *cols, s.prefixes(order.value, percent)], names=["id", "n", "sig", "vec", "fine", "tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, "id long, n long, sig long, vec binary, fine binary, tokens array<long>")


def _runs(batches, names: tuple, keys: int = 1):
    """Column arrays of whole runs of equal values in the first `keys` columns, RUN_BYTES or more at a time, from rows sorted by them."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        held.append(cols)
        size += batch.nbytes
        if size < RUN_BYTES:
            continue
        cols = [np.concatenate([h[i] for h in held]) for i in range(len(names))]
        other = np.flatnonzero(np.any([c != c[-1] for c in cols[:keys]], axis=0))
        edge = int(other[-1]) + 1 if len(other) else 0  # the last run may go on
        if edge:
            yield [c[:edge] for c in cols]
        held = [[c[edge:] for c in cols]]
        size = 0  # a longer run is joined again only after as many more rows
    if held:
        cols = [np.concatenate([h[i] for h in held]) for i in range(len(names))]
        if len(cols[0]):
            yield cols


def cells(nodes: DataFrame) -> DataFrame:
    """cell, family and sig of all cells with two nodes or more. Shingles whose cells have the same nodes are one cell, named by a hash of these nodes; cells with the same first node by hash are a family."""

    def run(batches):
        for token, sig in _runs(batches, ("token", "sig")):
            new = token[1:] != token[:-1]
            many = ~(np.append(True, new) & np.append(new, True))
            token, sig = token[many], sig[many]
            if not len(token):
                continue
            start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            size = np.diff(np.append(start, len(token)))
            name = mix(np.add.reduceat(mix(sig.view(np.uint64) ^ np.uint64(0x2545F4914F6CDD1D)), start) + size.astype(np.uint64)).view(np.int64)
            kept = np.zeros(len(start), bool)
            kept[np.unique(name, return_index=True)[1]] = True
            kept = np.repeat(kept, size)
            family = np.minimum.reduceat(mix(sig.view(np.uint64)), start).view(np.int64)
            yield pa.RecordBatch.from_pydict({"cell": np.repeat(name, size)[kept], "family": np.repeat(family, size)[kept], "sig": sig[kept]})

    each = nodes.select(F.explode("tokens").alias("token"), "sig")
    return each.repartition("token").sortWithinPartitions("token").mapInArrow(run, "cell long, family long, sig long").distinct()


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(np.append(True, new)[: len(keys[0])])


def _leaders(p: Points, sig, label, group, percent):
    """Pairs of each cell's nodes of a size class with their leaders: the first by hash, and the nearest to the mean point."""
    for k, rows in p.rows.items():
        start = _starts(*(g[rows] for g in group))
        mine = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(rows))))
        far = np.zeros(len(rows), np.float32)
        for x, y in zip(start.tolist(), [*start[1:].tolist(), len(rows)], strict=True):
            if y - x > 2:
                far[x:y] = np.abs(p.mat[k][x:y] - p.mat[k][x:y].mean(axis=0, dtype=np.float32)).sum(axis=1)
        for rank in (mix(sig[rows].view(np.uint64)), far):
            least = np.minimum.reduceat(rank, start)
            at = np.flatnonzero(rank == least[mine])
            lead = rows[at[np.searchsorted(mine[at], np.arange(len(start)))][mine]]
            keep = (label[rows] != label[lead]) & (100 * np.minimum(p.n[rows], p.n[lead]) >= percent * np.maximum(p.n[rows], p.n[lead]))
            i, j = rows[keep], lead[keep]
            bound = p.bound(i, j)
            near = bound >= overlap_needed(p.n[i], p.n[j], percent)
            yield i[near], j[near], bound[near]


def _trees(p: Points, sig, label, group, side, percent):
    """Pairs of nodes of different components that pass their cell's R-trees, one for each size class and each two neighbours. The trees of one leaf are joined all at once."""
    n, start = p.n, _starts(*group)
    end = np.append(start[1:], len(sig))
    mixed = np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start)
    across = np.maximum.reduceat(side, start) > 0
    tall = mixed & (across | (end - start > LEAF))
    for x, y, two in zip(start[tall].tolist(), end[tall].tolist(), across[tall].tolist(), strict=True):
        for k in np.unique(p.cls[x:y]).tolist():
            rows = x + np.flatnonzero(p.cls[x:y] == k)
            for i, j, bound in tree_join(n[rows], p.mat[k][p.at[rows]], label[rows], percent, side[rows] if two else None):
                yield rows[i], rows[j], bound
            top = SMALL << k  # sizes up to here are of class k
            rows = x + np.flatnonzero(((p.cls[x:y] == k) & (100 * n[x:y] >= percent * top)) | ((p.cls[x:y] == k + 1) & (percent * n[x:y] <= 100 * top)))
            upper = (p.cls[rows] == k + 1).astype(np.int64)
            for some in ((upper == side[rows]), (upper != side[rows])) if two else (np.ones(len(rows), bool),):
                some = rows[some]
                if len(some) and len(set(p.cls[some].tolist())) == 2:
                    for i, j, bound in tree_join(n[some], p.folded(some, k), label[some], percent, (p.cls[some] == k + 1).astype(np.int64)):
                        yield some[i], some[j], bound
    one, upto = start[mixed & ~tall], end[mixed & ~tall]
    for apart in range(1, LEAF):
        more = np.maximum(0, upto - one - apart)
        i = np.repeat(one - np.append(0, np.cumsum(more))[:-1], more) + np.arange(more.sum())
        j = i + apart
        near = (label[i] != label[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[near], j[near]
        bound = p.bound(i, j)
        near = bound >= overlap_needed(n[i], n[j], percent)
        yield i[near], j[near], bound[near]


def _best(sig, n, found):
    """Of pairs (i, j, bound) one for each node: that of the highest similarity that the bound allows, with that similarity."""
    i, j, bound = found
    share = bound / np.maximum(1, n[i] + n[j] - bound)
    i, j, share = np.append(i, j), np.append(j, i), np.append(share, share)
    order = np.lexsort((sig[j], -share, i))
    first = order[np.append(True, i[order][1:] != i[order][:-1])[: len(order)]]
    return i[first], j[first], share[first]


def _meet(cell_rows: DataFrame, nodes: DataFrame, labels: DataFrame | None, how: str, percent: int) -> DataFrame:
    """Pairs a < b of nodes of different components that meet in a cell: with its leaders, each node's nearest by its R-tree, or all that pass it."""
    names = ("cell", "s", "t", "side", "sig", "n", "label", "vec")

    def pairs(cols):
        cell, s, t, side, sig, n, label, vec = cols
        p, group = Points(n, vec), (cell, s, t)
        for i, j, bound in _leaders(p, sig, label, group, percent) if how == "leaders" else _trees(p, sig, label, group, side, percent):
            if how == "nearest":
                i, j, bound = _best(sig, n, (i, j, bound))
            if len(i):
                yield [(sig[i], sig[j], bound)]

    def reduced(held):
        """Each pair once; of nearest ones the best of each node."""
        a, b, share = (np.concatenate(x) for x in zip(*held, strict=True))
        if how == "nearest":
            order = np.lexsort((b, -share, a))
            a, b, share = a[order], b[order], share[order].astype(np.float64)
            new = np.append(True, a[1:] != a[:-1])
        else:
            a, b = np.minimum(a, b), np.maximum(a, b)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            share = np.zeros(len(a))
        return a[new], b[new], share[new]

    def run(batches):
        held, size, least = [], 0, PAIRS_OUT  # the cells of a family share pairs, so a task holds them as long as they are few
        for cols in _runs(batches, names, 3):
            for found in pairs(cols):
                held += found
                size += sum(len(x[0]) for x in found)
                if size > least:
                    held = [reduced(held)]
                    size = len(held[0][0])
                    if 2 * size > least:
                        yield batch_of(held[0])
                        held, size = [], 0
        if size:
            yield batch_of(reduced(held))

    def batch_of(x):
        cols = dict(zip(("a", "b", "share"), x, strict=True))
        return pa.RecordBatch.from_pydict(cols if how == "nearest" else {c: cols[c] for c in "ab"})

    known = nodes.select("sig", "n", "vec")
    if labels is not None:
        known = known.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left")
    known = known.withColumn("label", F.coalesce("label", "sig") if labels is not None else F.col("sig"))
    # Tasks get the cells of a family together, or parts of a large one, so that pairs that meet in many cells are passed on once.
    families = cell_rows.groupBy("family").agg(F.ceil(F.count("*") / FAMILY_ROWS).cast("int").alias("parts")).filter("parts > 1")
    # A large cell is dealt into blocks: each has leaders of its own, and each two of them are joined in a task.
    large = cell_rows.groupBy("cell").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("blocks")).filter("blocks > 1")
    own = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    each = cell_rows.join(large, "cell", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    each = each.withColumn("other", F.col("own") if how == "leaders" else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.join(families, "family", "left").select("cell", "family", "parts", F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), (F.col("own") > F.col("other")).cast("int").alias("side"), "sig")
    part = F.pmod(F.xxhash64("cell", "s", "t"), F.coalesce("parts", F.lit(1)))
    each = each.join(known, "sig").withColumn("part", part).repartition("family", "part").sortWithinPartitions("cell", "s", "t").select(*names)
    if how != "nearest":
        return each.mapInArrow(run, "a long, b long").distinct()
    best = each.mapInArrow(run, "a long, b long, share double").groupBy("a").agg(F.max(F.struct("share", "b"))["b"].alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose finer count vectors still allow the similarity."""
    side = lambda c: nodes.select(F.col("sig").alias(c), F.col("n").alias(f"n_{c}"), F.col("fine").alias(f"fine_{c}"))

    def run(batches):
        for batch in batches:
            n, m = (batch.column(f"n_{c}").to_numpy() for c in "ab")
            keep = pa.array(fine_bounds(batch.column("fine_a"), batch.column("fine_b")) >= overlap_needed(n, m, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """Pairs that reach the similarity on their whole sets. The texts are read again: only rows whose id passes a filter of the pairs' nodes, each named by its least id, are turned into sets. Rows without an id pass."""
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct().join(nodes.select("sig", "rep"), "sig"), "jaccard-wanted")
    bits = min(FILTER_BITS, max(1 << 12, 1 << (16 * wanted.count()).bit_length()))
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = wanted.filter("rep is not null").select(bit("rep").alias("bit")).groupBy((F.col("bit") / 64).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("bits")).toArrow()
    have = np.zeros(bits // 64, np.int64)  # at most FILTER_BITS / 8 bytes
    have[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    passes = docs.sparkSession.sparkContext.broadcast(np.unpackbits(have.view(np.uint8), bitorder="little"))

    def read(batches):
        have = passes.value
        for batch in batches:
            at = batch.column("bit").fill_null(-1).to_numpy(zero_copy_only=False)
            text = batch.column(text_col).filter(pa.array((at < 0) | (have[at] > 0)))
            for _, s in _sets(text):
                sig = s.signatures()
                some = np.flatnonzero(s.n > 0)
                yield pa.RecordBatch.from_arrays([pa.array(sig[some]), pa.array([s.items[s.at[r] : s.at[r + 1]].tobytes() for r in some.tolist()], pa.binary())], names=["sig", "items"])

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                i = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())  # both are in order
                ok.append(100 * i >= percent * (len(x) + len(y) - i))
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(ok, pa.bool_())) for c in "ab"], names=["a", "b"])

    # an id of another type than long is cast like the node's
    known = F.col(id_col).cast("long")
    whole = docs.select(F.when(known.isNotNull(), bit(known)).alias("bit"), text_col).mapInArrow(read, "sig long, items binary").join(wanted, "sig", "left_semi").dropDuplicates(["sig"])
    whole = written(whole, "jaccard-sets")
    release(whole.sparkSession)
    both = pairs.join(whole.select(F.col("sig").alias("a"), F.col("items").alias("x")), "a").join(whole.select(F.col("sig").alias("b"), F.col("items").alias("y")), "b")
    with arrow_rows(docs.sparkSession, SET_ROWS):
        out = written(both.mapInArrow(check, "a long, b long"), "jaccard-links")
    discard(wanted, whole)
    return out


def components(links: DataFrame) -> DataFrame:
    """node and label (a node of its component, one for all) of every node in links (a, b).

    Every round maps each node to the least of itself and its neighbours and contracts the links;
    node ids are hashes, so long chains shrink by a constant factor a round. Rounds are written out,
    in as few files as their rows need.
    """
    edges = written(links.filter("a <> b").distinct(), "components-edges")
    left = edges.count()
    names = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label")), "components-labels", rows=2 * left)
    total = names.count() if left else 0
    while left:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")), "components-least", rows=min(total, 2 * left))
        old = (edges, names)
        names = written(names.join(least, names["label"] == least["a"], "left").select("node", F.coalesce("to", "label").alias("label")), "components-labels", rows=total)
        x = edges.join(least, "a").select(F.col("to").alias("x"), "b")
        y = x.join(least.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = written(y.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "components-edges", rows=left)
        left = edges.count()
        discard(least, *old)
    return names


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """id, n_shingles and component_id (the least id that links reach) of every row.

    Null and empty texts have no shingles and are their own component; null ids never name a
    component unless all its ids are null. Repeated rows share a component. Other columns of docs
    are not carried along.
    """
    spark = docs.sparkSession
    all_sets = written(sets(docs, id_col, text_col, frequent(docs, text_col), percent), "jaccard-all")
    members = written(all_sets.select("id", "n", "sig"), "jaccard-members")
    nodes = written(all_sets.filter("n > 0").groupBy("sig").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n", "vec", "fine", "tokens"))), "jaccard-nodes")
    discard(all_sets)
    release(spark)
    shared = written(cells(nodes), "jaccard-cells")
    points_ = written(nodes.drop("tokens"), "jaccard-points")
    discard(nodes)
    release(spark)
    links, tried, labels = None, None, None
    for how in ("leaders", "nearest", "trees"):
        pairs = _bounded(_meet(shared, points_, labels, how, percent), points_, percent)
        pairs = written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
        release(spark)
        found = _verified(pairs, points_, docs, id_col, text_col, percent)
        release(spark)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if links is None or not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links)
    discard(shared, points_)
    known = members.join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    least = known.filter("label is not null").groupBy("label").agg(F.min("id").alias("least"))
    out = known.join(least, "label", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def brute_force(docs: list[tuple[int, str | None]], percent: int = PERCENT) -> dict:
    """The contract of op7 for tests: id -> (shingles, component)."""
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    made = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        made[d] = {tuple(w[i : i + WORDS]) for i in range(max(1, len(w) - WORDS + 1))} if w else set()
    parent = {d: d for d in made}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    by: dict[tuple, list] = {}
    for d, s in made.items():
        for x in s:
            by.setdefault(x, []).append(d)
    seen = set()
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    inter = len(made[a] & made[b])
                    if 100 * inter >= percent * (len(made[a]) + len(made[b]) - inter):
                        x, y = sorted((root(a), root(b)))
                        parent[y] = x
    return {d: (len(s), root(d)) for d, s in made.items()}

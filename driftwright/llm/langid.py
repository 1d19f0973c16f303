"""Language identification with a bidirectional gated recurrent network over bytes.

Every byte of a text is a position. A forward and a backward recurrent layer (gated recurrent
units) read the bytes, a softmax over languages labels every position, and a document's
probabilities are the mean over its positions. Texts are cut into segments that run side by side
as lanes of one batch; the state starts anew in each segment, and every byte of every text is read.

The network is trained on the driver by backpropagation through time with Adam, from a bounded
sample of labelled rows: whole texts, of each language the first in order of a seeded hash. The
number of steps is fixed and every step draws as many segments of each language, from anywhere in
its texts, so neither the size of the corpus nor the share of a language decides how well it is
learned. The network is broadcast: its size is fixed by its shape.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytewords import buffers, pieces
from .common import table, without

HIDDEN = 8
SEGMENT = 96
#: Labelled rows that the driver holds for training, at most, over all languages; bytes of a text of theirs.
SAMPLE, TRAIN_TEXT = 2000, 1 << 17
TRAIN_LENGTH = 64
STEPS, BATCH, RATE, SEED = 400, 128, 0.02, 7


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class ByteGru:
    """Parameters p[d]: embedding into the three gates (257, 3H; row 256 is padding), recurrent weights (H, 3H); out: (2H, L), (L,)."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels, self.h = labels, hidden
        scale = 1 / np.sqrt(hidden)
        self.p = {}
        for d in ("f", "b"):
            self.p[f"e{d}"] = rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
            self.p[f"u{d}"] = rng.uniform(-scale, scale, (hidden, 3 * hidden)).astype(np.float32)
        self.p["w"] = rng.normal(0, scale, (2 * hidden, len(labels))).astype(np.float32)
        self.p["c"] = np.zeros(len(labels), np.float32)

    def layer(self, x: np.ndarray, d: str, keep: bool = False):
        """States (T, n, H) of one direction over bytes x (T, n), in the order read; keep: what the way back needs."""
        h, e, u = self.h, self.p[f"e{d}"], self.p[f"u{d}"]
        uz, un = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((*x.shape, h), np.float32)
        saved = []
        for t in range(x.shape[0]):
            a = e[x[t]]
            zr = a[:, : 2 * h] + state @ uz
            zr *= 0.5
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            z, r = zr[:, :h], zr[:, h:]
            n = r * (state @ un)
            n += a[:, 2 * h :]
            np.tanh(n, out=n)
            if keep:
                saved.append((z, r, n, state))
            state = n + z * (state - n)
            out[t] = state
        return (out, saved) if keep else out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(T, n, L): the label probabilities of every position."""
        f, b = self.layer(x, "f"), self.layer(x[::-1], "b")[::-1]
        h = self.h
        y = f @ self.p["w"][:h] + b @ self.p["w"][h:] + self.p["c"]
        np.exp(y, out=y)
        y /= y.sum(-1, keepdims=True)
        return y

    def gradients(self, x: np.ndarray, label: np.ndarray) -> tuple[dict, float]:
        """Of the mean cross-entropy over all positions that are not padding, by backpropagation through time."""
        h, g = self.h, {k: np.zeros_like(v) for k, v in self.p.items()}
        f, sf = self.layer(x, "f", True)
        b, sb = self.layer(x[::-1], "b", True)
        y = f @ self.p["w"][:h] + b[::-1] @ self.p["w"][h:] + self.p["c"]
        y = np.exp(y - y.max(-1, keepdims=True))
        y /= y.sum(-1, keepdims=True)
        live = (x < 256)[..., None].astype(np.float32)
        total = max(1.0, float(live.sum()))
        rows = np.arange(x.shape[1])
        loss = -float((np.log(y[:, rows, label] + 1e-9) * live[..., 0]).sum()) / total
        dy = y
        dy[:, rows, label] -= 1
        dy *= live / total
        flat = dy.reshape(-1, dy.shape[-1])
        g["w"][:h] = f.reshape(-1, h).T @ flat
        g["w"][h:] = b[::-1].reshape(-1, h).T @ flat
        g["c"] = flat.sum(0)
        for d, saved, xs, ds in (("f", sf, x, dy @ self.p["w"][:h].T), ("b", sb, x[::-1], (dy @ self.p["w"][h:].T)[::-1])):
            u = self.p[f"u{d}"]
            back = np.zeros((x.shape[1], h), np.float32)
            for t in range(x.shape[0] - 1, -1, -1):
                z, r, n, s = saved[t]
                dh = ds[t] + back
                dn = dh * (1 - z) * (1 - n * n)
                rec = s @ u[:, 2 * h :]
                dz = dh * (s - n) * z * (1 - z)
                dr = dn * rec * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                dr_n = dn * r
                np.add.at(g[f"e{d}"], xs[t], np.concatenate([dzr, dn], 1))
                g[f"u{d}"][:, : 2 * h] += s.T @ dzr
                g[f"u{d}"][:, 2 * h :] += s.T @ dr_n
                back = dh * z + dzr @ u[:, : 2 * h].T + dr_n @ u[:, 2 * h :].T
        return g, loss


def train(rows: list[tuple[bytes, str]], *, hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = SEED) -> ByteGru:
    """A network fitted to (bytes, language) rows: each step takes segments from seeded places, as many of each language; the rate falls to a tenth."""
    labels = sorted({lang for _, lang in rows})
    net = ByteGru(labels, hidden, seed)
    rng = np.random.default_rng(seed)
    label = np.array([labels.index(lang) for _, lang in rows])
    own = [np.flatnonzero(label == k) for k in range(len(labels))]
    size = np.array([len(raw) for raw, _ in rows])
    offs = np.cumsum(size) - size
    data = np.frombuffer(b"".join(raw for raw, _ in rows), np.uint8)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    t = np.arange(TRAIN_LENGTH)[:, None]
    for step in range(1, steps + 1):
        part = np.concatenate([rng.choice(rows_of, -(-batch // len(own))) for rows_of in own])
        at = rng.integers(0, np.maximum(1, size[part] - TRAIN_LENGTH + 1))
        x = np.where(at + t < size[part], data[np.minimum(offs[part] + at + t, len(data) - 1)], 256).astype(np.int64)
        g, _ = net.gradients(x, label[part])
        norm = float(np.sqrt(sum((a * a).sum() for a in g.values())))
        now = rate * (1 - 0.9 * step / steps)
        for k, w in net.p.items():
            a = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            w -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
    return net


def pooled(net: ByteGru, column: pa.Array) -> np.ndarray:
    """Mean label probabilities (rows, L) over every byte of each text; a row without bytes has zeros."""
    raw, offs = buffers(column)
    size = np.diff(offs)
    count = -(-size // SEGMENT)
    row = np.repeat(np.arange(len(size)), count)
    begin = offs[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
    length = np.minimum(SEGMENT, offs[1:][row] - begin)
    out = np.zeros((len(size), len(net.labels)))
    order = np.argsort(length, kind="stable")
    for lanes in np.array_split(order, max(1, len(order) // 2048)):
        if not len(lanes):
            continue
        t = np.arange(int(length[lanes].max()))[:, None]
        inside = t < length[lanes]
        x = np.where(inside, raw[np.minimum(begin[lanes] + t, len(raw) - 1)], 256).astype(np.int64)
        y = net.probabilities(x)
        # Padding stands at a segment's end; the backward layer reads it first, as in training.
        np.add.at(out, row[lanes], (y * inside[..., None]).sum(0))
    return out / np.maximum(size, 1)[:, None]


def identify_language(docs: DataFrame, net: ByteGru | None, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (the pooled probability of lang_pred, 0 to 1).

    A text that is null or has no letter (Unicode) is "und" with score 0; so is every text if net is
    None (no labelled row to learn from). Rows are kept one for one; same-named columns are replaced.
    """
    docs = without(docs, "lang_pred", "score")
    model = docs.sparkSession.sparkContext.broadcast(net)
    schema = docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)}).schema

    def run(batches):
        for batch in batches:
            column, net = batch.column(text_col), model.value
            letters = np.array([t is not None and any(map(str.isalpha, t)) for t in column.to_pylist()], bool)
            pred, score = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            for lo, hi in pieces(column, 1 << 20) if net is not None else ():
                p = pooled(net, column.slice(lo, hi - lo))
                best = p.argmax(1)
                pred[lo:hi] = np.array(net.labels, object)[best]
                score[lo:hi] = np.clip(p[np.arange(len(p)), best], 0, 1)
            pred[~letters], score[~letters] = "und", 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id):
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, *, sample: int = SAMPLE, most_bytes: int = TRAIN_TEXT, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> ByteGru | None:
    """A network trained on at most `sample` labelled rows that are not held out; None without any.

    The rows are whole texts, of each language the first by a hash of their id, as many of each as the
    sample has room for; a text of more than `most_bytes` is no training row unless its language has
    no other. Tasks pass on only rows whose hash is below a bound of their language that leaves about
    twice its part (widened if it leaves less), so what reaches the driver does not grow with the
    number of tasks or of documents.
    """
    rows = docs.filter(~held_out(F.col(id_col)) & F.col(lang_col).isNotNull() & (F.octet_length(text_col) > 0))
    rows = rows.select(F.xxhash64(F.col(id_col).cast("string"), F.lit(SEED)).alias("o"), F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    fits = F.octet_length("t") <= most_bytes
    counts = rows.groupBy("l").agg(F.count_if(fits).alias("n"), F.min_by("i", F.struct(F.octet_length("t"), "o", "i")).alias("least")).collect()
    counts = sorted(counts, key=lambda c: c["l"])[:sample]
    each, factor, found = max(1, sample // max(1, len(counts))), 2, []
    alone = [c for c in counts if not c["n"]]  # only long texts: the shortest
    todo = {c["l"]: c["n"] for c in counts if c["n"]}
    while todo:
        share = {lang: min(1.0, factor * each / n) for lang, n in todo.items()}
        spark = docs.sparkSession
        bound = spark.createDataFrame([(lang, None if x == 1 else int(x * 2**64) - 2**63) for lang, x in share.items()], "l string, bound long")
        near = rows.filter(fits).join(F.broadcast(bound), "l").filter("bound IS NULL OR o < bound")
        first = near.withColumn("k", F.row_number().over(Window.partitionBy("l").orderBy("o", "i", "t"))).filter(F.col("k") <= each)
        got = first.select("l", "t").collect()
        for lang in list(todo):
            mine = [r["t"] for r in got if r["l"] == lang]
            if share[lang] == 1 or len(mine) == each:
                found += [(t.encode(), lang) for t in mine]
                del todo[lang]
        factor *= 4
    for c in alone:
        found += [(r["t"].encode(), c["l"]) for r in rows.filter((F.col("l") == c["l"]) & F.col("i").eqNullSafe(c["least"])).limit(1).collect()]
    return train(sorted(found)) if found else None


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify_language(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

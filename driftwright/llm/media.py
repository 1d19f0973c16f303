"""Media columns: payloads stored losslessly in ZIP archives and read by a custom data source.

`pack` writes each row's payload as a media file (8-bit greyscale PNG, 192 samples a line) into
archives in the shared folder and commits a manifest of them. The "media_archive" data source plans
byte-range partitions: each covers a range of one archive, and its reader takes from the archive's
directory the members whose header lies in that range. Payloads stream back as Arrow batches of
bounded bytes. A member that fails to read or check is retried by its own offset, without the rest
of its range; what still fails becomes a row with an error.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import filesystem, new_path, table, without

LINE = 192
ARCHIVE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 8 << 20
RETRIES = 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The payload (a positive multiple of 192 bytes) as the samples of a greyscale PNG; the unpadded length is kept as text."""
    height = len(payload) // LINE
    lines = np.zeros((height, LINE + 1), np.uint8)  # each line starts with its filter, 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(height, LINE)
    header = struct.pack(">IIBBBBB", LINE, height, 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"tEXt", b"n_bytes\0%d" % n_bytes) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 3)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of what encode() made; checks every chunk's checksum."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG file")
    at, data, n_bytes, size = 8, [], None, None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"checksum of {kind!r} differs")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    width, height = size
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a line is filtered")
    payload = lines[:, 1:].tobytes()
    return payload, len(payload) if n_bytes is None else n_bytes


def feature(payload: bytes) -> str:
    """Lines, mean, deviation, mean step between samples (thousandths) and the shares of 8 equal ranges of sample values (thousandths)."""
    x = np.frombuffer(payload, np.uint8)
    n, total = len(x), int(x.sum(dtype=np.int64))
    square = int((x.astype(np.int64) ** 2).sum())
    step = int(np.abs(np.diff(x.astype(np.int16))).sum(dtype=np.int64))
    shares = np.bincount(x >> 5, minlength=8) * 1000 // n
    variance = (square * n - total * total) // (n * n)
    return f"{n // LINE};{total * 1000 // n};{int(variance**0.5 * 1000)};{step * 1000 // max(1, n - 1)};{','.join(map(str, shares))}"


def pack(rows: DataFrame, *, key_col: str, payload_col: str, length_col: str, archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Writes each row's payload into archives in a new shared folder and returns the folder.

    Every attempt of a task writes archives of its own; the manifest, committed by Spark, names only
    those of attempts that succeeded. A null key gives a member without a name.
    """
    folder = new_path(rows.sparkSession, "media")

    def write(batches):
        store, root = filesystem(folder)
        store.create_dir(root, recursive=True)
        name, out, held = None, None, 0

        def close():
            out.close()
            sink.close()
            size = store.get_file_info(f"{root}/{name}").size
            return pa.RecordBatch.from_pydict({"archive": [name], "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for key, payload, n in zip(*(batch.column(c) for c in (key_col, payload_col, length_col)), strict=True):
                if out is None:
                    name, held = f"{uuid.uuid4().hex}.zip", 0
                    sink = store.open_output_stream(f"{root}/{name}")
                    out = zipfile.ZipFile(_Unseekable(sink), "w", zipfile.ZIP_STORED)
                media = encode(payload.as_py(), n.as_py())
                out.writestr(zipfile.ZipInfo("" if key.as_py() is None else f"{key.as_py()}.png"), media)
                held += len(media)
                if held >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    rows.select(key_col, payload_col, length_col).mapInArrow(write, "archive string, bytes long").write.parquet(f"{folder}/manifest")
    return folder


class _Unseekable(io.RawIOBase):
    """A write-only stream, as object stores offer; zipfile then writes data descriptors."""

    def __init__(self, sink):
        self.sink = sink

    def writable(self):
        return True

    def write(self, data):
        self.sink.write(bytes(data))
        return len(data)

    def flush(self):
        pass


@dataclass
class ByteRange(InputPartition):
    archive: str
    size: int
    start: int
    end: int


class MediaArchives(DataSource):
    """Members of the archives that a folder's manifest names. Options: path, range_bytes, batch_bytes, retries."""

    @classmethod
    def name(cls):
        return "media_archive"

    def schema(self):
        return "member string, archive string, offset long, media binary, error string"

    def reader(self, schema):
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self):
        """Ranges of every archive in the manifest; only names and sizes come to the planner, members don't."""
        import pyarrow.dataset as ds

        store, root = filesystem(self.folder)
        names = ds.dataset(f"{root}/manifest", filesystem=store, format="parquet", schema=pa.schema([("archive", pa.string()), ("bytes", pa.int64())])).to_table().to_pylist()
        out = [ByteRange(x["archive"], x["bytes"], a, min(a + self.range_bytes, x["bytes"])) for x in names for a in range(0, x["bytes"], self.range_bytes)]
        return out or [ByteRange("", 0, 0, 0)]

    def read(self, partition):
        if not partition.archive:
            return
        store, root = filesystem(self.folder)
        path = f"{root}/{partition.archive}"
        for attempt in range(self.retries):
            try:
                with store.open_input_file(path) as f:
                    members = [m for m in zipfile.ZipFile(f).infolist() if partition.start <= m.header_offset < partition.end]
                break
            except (OSError, zipfile.BadZipFile):
                if attempt == self.retries - 1:
                    raise
                time.sleep(0.1 * 2**attempt)
        held, size = [], 0
        file = store.open_input_file(path)
        try:
            for m in members:
                media, error = None, None
                for attempt in range(self.retries):
                    try:
                        media, error = member_at(file, m), None
                        break
                    except (OSError, ValueError) as e:  # this member alone, by its offset, on a new handle
                        error = str(e)
                        time.sleep(0.05 * 2**attempt)
                        file.close()
                        file = store.open_input_file(path)
                held.append((m.filename or None, partition.archive, m.header_offset, media, error))
                size += len(media or b"")
                if size >= self.batch_bytes:
                    yield _batch(held)
                    held, size = [], 0
        finally:
            file.close()
        if held:
            yield _batch(held)


def member_at(file, m: zipfile.ZipInfo) -> bytes:
    """The bytes of one stored member, by its offset; raises ValueError if they don't match their checksum."""
    file.seek(m.header_offset)
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no member header at the offset")
    name, extra = struct.unpack("<HH", head[26:30])
    file.seek(m.header_offset + 30 + name + extra)
    data = file.read(m.compress_size)
    if len(data) != m.file_size or zlib.crc32(data) != m.CRC:
        raise ValueError("member differs from its checksum")
    return data


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("member", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def read_media(spark: SparkSession, folder: str, **options) -> DataFrame:
    """member, archive, offset, media, error of every member packed into the folder."""
    spark.dataSource.register(MediaArchives)
    reader = spark.read.format("media_archive").option("path", folder)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def features(media: DataFrame, *, media_col: str = "media") -> DataFrame:
    """media with n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and feature, from the stored bytes.

    A null media (a member that could not be read) gives nulls. Same-named columns are replaced.
    """
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    media = without(media, *names)
    added = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    keep = [c for c in media.columns if c != media_col]
    schema = media.select(*keep).schema
    for f in media.sparkSession.createDataFrame([], added).schema:
        schema = schema.add(f)

    def one(stored):
        if stored is None:
            return (None,) * 7
        payload, n = decode(stored)
        return n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(payload)

    def run(batches):
        for batch in batches:
            cols = list(zip(*(one(m.as_py()) for m in batch.column(media_col)), strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*keep, *names])

    return media.mapInArrow(run, schema)


def padded(text):
    """A text's UTF-8 bytes (null: none), with spaces up to a positive multiple of 192 bytes, and their unpadded number."""
    raw = F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))
    n = F.octet_length(raw)
    total = F.greatest(F.lit(LINE), F.ceil(n / LINE) * LINE)
    return F.rpad(raw, total.cast("int"), F.lit(b" ")), n.cast("long")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    payload, n = padded(F.col("text"))
    folder = pack(docs.select("doc_id", payload.alias("payload"), n.alias("n_bytes")), key_col="doc_id", payload_col="payload", length_col="n_bytes")
    stored = read_media(spark, folder).select(F.regexp_extract("member", r"^(-?\d+)\.png$", 1).alias("key"), "media", F.when(F.col("error").isNotNull(), F.raise_error("error")).alias("error"))
    found = features(stored.select(F.expr("try_cast(key AS long)").alias("doc_id"), "media", "error"))
    return found.drop("error")

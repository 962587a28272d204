"""Media columns: content-addressed payloads in tar shards, with header-only range reads for the metadata.

A text's payload is its UTF-8 bytes and zero bytes up to a positive multiple of 64, kept as the samples of an 8-bit
greyscale PNG image 64 samples wide.  A shard is an ordinary tar file whose members are named by the SHA-256 of their
bytes; within a shard equal content is stored once.  An index row carries the member's digest, shard, offset and length,
and the text's own byte count.  Width, height and depth come from range reads of a member's first 33 bytes; payloads
are read back by range as well, and their features are whole-number statistics of the samples.

Defined results: null text is empty, so its payload is 64 zero bytes; equal texts give equal values; repeated rows each
have an index row; null ids stay null; other columns are not read.

At scale: writing is one map, without a shuffle: a task streams its rows into shards of bounded size under names of its
own attempt, and only finished tasks' index rows are kept.  Copies in different shards are stored once a shard: the
digest says that they are equal, and no shuffle of payloads is paid for it.  Reading back goes over the index in ranges
of (shard, offset), so each task reads stretches of few shards in order.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import storage
from quern.llm.textcore import text_buffers, trimmed, unsigned_crc32

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
SHARD_BYTES = 64 << 20
SHARD_ROWS = 1 << 15
READ_BYTES = 16 << 20
INDEX = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_image(payload: bytes, level: int = 6) -> bytes:
    """A payload of a multiple of 64 bytes as a PNG."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from an image's first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not such an image")
    return struct.unpack(">IIB", head[16:25])


def from_image(image: bytes) -> bytes:
    """The samples, with every chunk's checksum verified."""
    width, height, _ = read_header(image)
    at, packed = 8, []
    while at < len(image):
        (n,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum differs")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Histogram of the samples' high halves in 255ths, and which of 8x8 cells, of all samples, lie above the mean."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x >> 4, minlength=16) * 255 // len(x)
    columns = x.reshape(-1, 8, 8).sum(2, dtype=np.int64)
    start = np.arange(8) * len(columns) // 8  # fewer than eight rows stand for several bands each
    size = np.maximum(1, np.diff(start, append=len(columns)))[:, None]
    cells = np.add.reduceat(columns, start, axis=0)
    bits = np.packbits((cells / size > 8 * (x.sum(dtype=np.int64) / len(x))).reshape(-1))
    return f"h{counts.astype(np.uint8).tobytes().hex()}c{bits.tobytes().hex()}"


def tar_header(name: str, size: int) -> bytes:
    """A ustar header for a regular file, with fixed times and owners so that equal content gives equal bytes."""
    field = lambda n, width: f"{n:0{width - 1}o}\0".encode() if n < 8 ** (width - 1) else b"\x80" + n.to_bytes(width - 1, "big")
    head = bytearray(512)
    for at, part in ((0, name.encode()), (100, field(0o644, 8)), (108, field(0, 8)), (116, field(0, 8)), (124, field(size, 12)), (136, field(0, 12)), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        head[at : at + len(part)] = part
    head[148:156] = f"{sum(head):06o}\0 ".encode()
    return bytes(head)


class ShardWriter:
    """One tar shard being streamed; ``add`` returns a member's digest, offset and length."""

    def __init__(self, path: str):
        self.path = path
        fs, at = storage.filesystem(path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.out, self.at, self.rows = fs.open_output_stream(at), 0, 0
        self.known: dict[bytes, tuple[str, int, int]] = {}

    def add(self, payload: bytes) -> tuple[str, int, int]:
        self.rows += 1
        key = hashlib.sha256(payload).digest()
        if key not in self.known:
            image = to_image(payload)
            digest = hashlib.sha256(image).hexdigest()
            self.out.write(tar_header(f"{digest}.png", len(image)) + image + bytes(-len(image) % 512))
            self.known[key] = digest, self.at + 512, len(image)
            self.at += 512 + len(image) + -len(image) % 512
        return self.known[key]

    def full(self) -> bool:
        return self.at >= SHARD_BYTES or self.rows >= SHARD_ROWS

    def close(self) -> None:
        self.out.write(bytes(1024))
        self.out.close()


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all payloads; returns the index."""
    storage.modest_batches(docs.sparkSession)
    folder = storage.new_folder(docs.sparkSession, "media")

    def work(batches):
        part, shard = TaskContext.get().partitionId(), None
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            got = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                if shard is None:
                    shard = ShardWriter(storage.attempt_path(folder, f"{part:06d}", ".tar"))
                raw = data[a:b].tobytes()
                got.append((len(raw), *shard.add(raw + bytes(-len(raw) % WIDTH if raw else WIDTH)), shard.path))
                if shard.full():
                    shard.close()
                    shard = None
            if got:
                n, digest, offset, length, path = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest), pa.array(path), pa.array(offset, pa.int64()), pa.array(length, pa.int64())], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if shard is not None:
            shard.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return storage.stored(rows.mapInArrow(trimmed(work), INDEX), "media-index")


class RangeReader:
    """Ranges of shards, with the last shard kept open."""

    def __init__(self):
        self.path, self.file = "", None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            fs, at = storage.filesystem(path)
            self.path, self.file = path, fs.open_input_file(at)
        return self.file.read_at(length, offset)


def fill_metadata(index: DataFrame) -> DataFrame:
    """The index with width, height and depth, from reads of each member's first bytes alone."""

    def work(batches):
        reader = RangeReader()
        for batch in batches:
            heads = [read_header(reader.read(s, o, HEADER_BYTES)) for s, o in zip(batch.column("shard").to_pylist(), batch.column("offset").to_pylist(), strict=True)]
            cols = [pa.array([h[k] for h in heads], pa.int32()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "width", "height", "depth"])

    return index.mapInArrow(trimmed(work), f"{INDEX}, width int, height int, depth int")


def read_back(index: DataFrame) -> DataFrame:
    """Per index row, from the stored bytes: payload and media sizes and digests, and the feature."""
    stats = index.agg(F.sum("length").alias("b"), F.count("*").alias("n")).first()
    parts = max(1, math.ceil((stats.b or 0) / READ_BYTES), math.ceil(stats.n / SHARD_ROWS))
    ordered = index.repartitionByRange(parts, "shard", "offset", "doc_id").sortWithinPartitions("shard", "offset")

    def work(batches):
        reader, last, value = RangeReader(), None, None
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "depth"]
        for batch in batches:
            got = []
            cols = [batch.column(c).to_pylist() for c in ("shard", "offset", "length", "digest", "width", "height")]
            for shard, offset, length, digest, width, height in zip(*cols, strict=True):
                if (shard, offset) != last:
                    image = reader.read(shard, offset, length)
                    media = hashlib.sha256(image).hexdigest()
                    payload = from_image(image)
                    if media != digest or len(payload) != width * height:
                        raise ValueError(f"{shard} at {offset} holds other bytes than its index says")
                    value = (len(payload), hashlib.sha256(payload).hexdigest(), unsigned_crc32(payload[-64:]), len(image), media, feature(payload))
                    last = shard, offset
                got.append(value)
            if got:
                n, sha, crc, size, media, feat = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64()), pa.array(sha), pa.array(crc, pa.int64()), pa.array(size, pa.int64()), pa.array(media), pa.array(feat), *(batch.column(c) for c in ("width", "height", "depth"))], names=names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, depth int"
    return fill_metadata(ordered).mapInArrow(trimmed(work), schema)


def media_table(docs: DataFrame, **columns) -> DataFrame:
    """Writes all texts' payloads and reads them back."""
    return read_back(write_shards(docs, **columns))

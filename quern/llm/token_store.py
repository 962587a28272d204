"""Token-id files with directly addressable codes.

Each id is cut into chunks of fixed widths, the lowest first.  Level k holds the k-th chunk of every id that has one,
and a bitmap that says which of them go on at level k+1.  A rank directory (ones before every 512 bits) turns a place
in level k into its place in level k+1, so any single id is found with one chunk and one rank per level, and no block
is ever decoded.  A shard file holds the levels, the documents' ids and the place of each document's first token.

Results are defined for every input: documents come in ascending ``doc_id`` order, null ids first, rows of equal id in
order of their text; a null text is an empty one, and has the end id only.  Columns other than the id and the text do
not matter.  No row is dropped; a table without rows gives a result without rows.

At scale: one range shuffle of (doc_id, text), whose ranges part rows of one id by their texts' beginnings; each task streams its range into shard files of a bounded number of
tokens; what comes back to the driver is one total per task.  A lost executor's task writes new files under new names.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import storage
from quern.llm.textcore import trimmed, unsigned_crc32
from quern.llm.tokenization import encoder

MAGIC = b"DACTOK01"
WIDTHS = (8, 8, 8, 8)
SUPER = 512
SHARD_TOKENS = 1 << 22
SPREAD_CHARS = 32
_HEAD = struct.Struct("<8sQQI")
_LEVEL = struct.Struct("<IQQQQ")
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _chunk_type(width: int):
    return np.uint8 if width <= 8 else np.uint16


def encode(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Levels as (width, count, chunks, bitmap bytes, rank directory)."""
    rest, levels = np.asarray(ids).astype(np.uint64), []
    for k, width in enumerate(widths):
        low = (rest & np.uint64((1 << width) - 1)).astype(_chunk_type(width))
        rest = rest >> np.uint64(width)
        on = rest > 0
        if k + 1 == len(widths) and on.any():
            raise ValueError("an id has more bits than the chunk widths hold")
        bits = np.packbits(on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (SUPER // 8), np.uint8)])
        ones = _POPCOUNT[bits].reshape(-1, SUPER // 8).sum(1, dtype=np.uint64)
        levels.append((width, len(low), low, bits, (np.cumsum(ones) - ones).astype(np.uint64)))
        rest = rest[on]
        if not len(rest):
            break
    return levels


class Reader:
    """A shard in memory or memory-mapped: ``reader[i]`` reads one token by ranks alone; ``ids(a, b)`` a range."""

    def __init__(self, data):
        self.raw = np.frombuffer(data, np.uint8)
        magic, self.n_tokens, self.n_docs, n_levels = _HEAD.unpack_from(data, 0)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at, self.levels = _HEAD.size, []
        for _ in range(n_levels):
            width, count, chunks, bits, ranks = _LEVEL.unpack_from(data, at)
            at += _LEVEL.size
            blocks = (count + SUPER - 1) // SUPER
            self.levels.append((width, self._view(chunks, count, _chunk_type(width)), self._view(bits, blocks * SUPER // 8, np.uint8), self._view(ranks, blocks, np.uint64)))
        doc_ids, known, starts = struct.unpack_from("<QQQ", data, at)
        self.doc_ids, self.known, self.starts = self._view(doc_ids, self.n_docs, np.int64), self._view(known, self.n_docs, np.uint8), self._view(starts, self.n_docs + 1, np.int64)

    def _view(self, at: int, count: int, kind) -> np.ndarray:
        return self.raw[at : at + count * np.dtype(kind).itemsize].view(kind)

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        block = i // SUPER
        a, b = block * SUPER // 8, i // 8
        return int(ranks[block]) + int(_POPCOUNT[bits[a:b]].sum()) + int(bin(int(bits[b]) & ((1 << i % 8) - 1)).count("1"))

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for width, chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            i, shift = self._rank(bits, ranks, i), shift + width
        return value

    def ids(self, a: int = 0, b: int | None = None) -> np.ndarray:
        """Tokens a to b, each level's range found by two ranks."""
        b = self.n_tokens if b is None else b
        out, shift, places = np.zeros(b - a, np.uint32), 0, None
        for width, chunks, bits, ranks in self.levels:
            part = chunks[a:b].astype(np.uint32) << np.uint32(shift)
            if places is None:
                out |= part
            else:
                out[places] |= part
            if a == b:
                break
            on = np.unpackbits(bits[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 :][: b - a].astype(bool)
            places = np.flatnonzero(on) if places is None else places[on]
            a = self._rank(bits, ranks, a)
            b, shift = a + len(places), shift + width
            if not len(places):
                break
        return out


def shard_parts(doc_ids: np.ndarray, known: np.ndarray, starts: np.ndarray, ids: np.ndarray, widths=WIDTHS) -> list[bytes]:
    """A shard file's parts in order."""
    levels = encode(ids, widths)
    at = _HEAD.size + len(levels) * _LEVEL.size + 24
    body, table = [], []

    def put(x: np.ndarray) -> int:
        nonlocal at
        raw = x.tobytes() + bytes(-x.nbytes % 8)
        body.append(raw)
        at += len(raw)
        return at - len(raw)

    at += (pad := -at % 8)
    body.append(bytes(pad))
    for width, count, chunks, bits, ranks in levels:
        table.append(_LEVEL.pack(width, count, put(chunks), put(bits), put(ranks)))
    tail = struct.pack("<QQQ", put(doc_ids.astype(np.int64)), put(known.astype(np.uint8)), put(starts.astype(np.int64)))
    return [_HEAD.pack(MAGIC, len(ids), len(doc_ids), len(levels)), *table, tail, *body]


def open_shard(path: str) -> Reader:
    fs, at = storage.filesystem(path)
    if fs.type_name == "local":
        return Reader(np.memmap(at, np.uint8, "r"))
    with fs.open_input_file(at) as f:
        return Reader(f.read_buffer())


_MANIFEST = "part int, seq int, path string, n_tokens long, n_docs long"


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, shard_tokens: int = SHARD_TOKENS, widths: tuple[int, ...] = WIDTHS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files; returns their manifest: part, seq, path, n_tokens, n_docs, and the tokens before each."""
    spark = docs.sparkSession
    storage.modest_batches(spark)
    folder = storage.new_folder(spark, "tokens")

    def work(batches):
        enc, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def flush():
            nonlocal seq
            sizes = np.concatenate([x[2] for x in held])
            ids = np.concatenate([x[3] for x in held])
            path = storage.attempt_path(folder, f"{part:06d}-{seq:05d}", ".dac")
            storage.write_file(path, *shard_parts(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), np.concatenate(([0], np.cumsum(sizes))), ids, widths))
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "n_tokens": len(ids), "n_docs": len(sizes)}], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_tokens", pa.int64()), ("n_docs", pa.int64())]))
            held.clear()
            seq += 1
            return row

        for batch in batches:
            key = batch.column(0)
            known = np.asarray(key.is_valid().to_numpy(zero_copy_only=False), bool)
            names = key.fill_null(0).to_numpy(zero_copy_only=False)
            for a, ids, ends in enc.encode_column(batch.column(1), end_id):
                n = len(ends) - 1
                held.append((names[a : a + n], known[a : a + n], np.diff(ends), ids))
                if sum(len(x[3]) for x in held) >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # a text's first characters don't go against the order of texts, so rows of one id, or of none, are spread by them
    ordered = source.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.substring("text", 1, SPREAD_CHARS).asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    manifest = storage.stored(ordered.mapInArrow(trimmed(work, keeps=("encoders",)), _MANIFEST), "manifest")
    totals = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # one row a task
    before, base = 0, []
    for r in totals:
        base.append((r.part, before))
        before += r.n
    bases = spark.createDataFrame(base, "part int, base long")
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return manifest.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + within).drop("base")


def read_documents(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = manifest.sparkSession

    def work(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = open_shard(path)
                ids = shard.ids().astype("<u4")
                at = shard.starts
                view = memoryview(ids).cast("B")
                crc = [unsigned_crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                doc = pa.array(shard.doc_ids, mask=shard.known == 0)
                yield pa.RecordBatch.from_arrays([doc, pa.array(at[:-1] + start), pa.array(np.diff(at)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files = manifest.select("path", "start")
    return files.repartition(storage.tasks_for(spark, files.count())).mapInArrow(trimmed(work), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_store(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """Writes all documents' ids and reads them back."""
    return read_documents(write_tokens(docs, tokenizer, **options))

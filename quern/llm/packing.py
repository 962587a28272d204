"""Packing of documents into windows by Karmarkar-Karp multiway differencing.

Each document is its token ids and an end id.  Whole windows are cut from documents longer than a window; what is left
of each document (its tail) goes, a block of documents at a time, to the differencing method: a heap of partial
partitions, each k sums, of which the two with the largest imbalance (largest less smallest sum) are merged, the
largest sums of one with the smallest of the other, until one partition into k near-equal windows is left.  Where
documents must stay whole (``windows``) the count k rises while a window exceeds the capacity.  Here they may be cut, so
a block takes as many tokens as k windows hold, and holds back its last documents' rest for the next block: whenever
what is held exceeds the windows so far, their count rises.  The windows of the differencing then differ from the
capacity by little (under one part in 200 of all tokens, a test says); just that is cut off the heavier ones and fills
the lighter ones.  So windows are full, a task pads one at its end only, and cuts that one at a power of two where this
pads less.

Very short tails are glued to items of ``GLUED`` tokens first, so a block has a bounded number of items.

Defined results: null text is empty (the end id only); rows of equal id are separate documents; null ids stay null;
a table without rows gives no pieces.  Every id of every row lies in exactly one piece.

At scale: no shuffle; each task packs its own input stream in bounded blocks, and sequence numbers are the task's number
and a counter.  Tables whose rows are in an order to keep are packed by ``place``, each row's whole-number place in that
order: rows of consecutive places are a stream, wherever it is read, and its sequence numbers are the first row's place
and a counter, so they follow the order whatever files a task reads and in whatever sequence.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import modest_batches
from quern.llm.textcore import trimmed, unsigned_crc32
from quern.llm.tokenization import encoder

BLOCK_TOKENS, GLUED = 1 << 20, 64
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Parts item numbers into k sets of near-equal sums by multiway differencing."""
    # A partial partition: its non-zero slots as (sum, tree of items), ascending; absent slots are zero.
    heap: list[tuple[int, int, list[tuple[int, int, object]]]] = [(-s, i, [(s, i, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:  # the smallest `over` slots of a meet the smallest of b crosswise: a's largest of them with b's smallest
            merged = a[over:] + b[over:]
            merged += [(x[0] + y[0], x[1], (x[2], y[2])) for x, y in zip(a[:over], reversed(b[:over]), strict=True)]
        merged.sort(key=lambda x: x[:2])
        imbalance = merged[-1][0] - (merged[0][0] if len(merged) == k else 0)
        heapq.heappush(heap, (-imbalance, serial, merged))
        serial += 1
    slots = heap[0][2] if heap else []
    out = []
    for _, _, tree in slots:
        stack, items = [tree], []
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                items.append(x)
        out.append(items)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most ``capacity`` each; the count rises until none exceeds it."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = differencing(sizes, k)
        if max(sum(sizes[i] for i in s) for s in sets) <= capacity:
            return sets
        k += max(1, k // 50)


def near_equal(tails: list[tuple], k: int) -> list[list[tuple]]:
    """The differencing's k windows of tails (doc_id, start, ids, total), short ones glued before."""
    items, glue, room = [], [], 0
    for t in tails:
        if len(t[2]) >= GLUED:
            items.append([t])
        elif room >= len(t[2]):
            glue.append(t)
            room -= len(t[2])
        else:
            glue = [t]
            items.append(glue)
            room = GLUED - len(t[2])
    sets = differencing([sum(len(t[2]) for t in item) for item in items], k)
    return [[t for i in s for t in items[i]] for s in sets] + [[] for _ in range(k - len(sets))]


def levelled(filled: list[list[tuple]], capacity: int) -> list[list[tuple]]:
    """Windows of exactly ``capacity`` on average, made so exactly: what one has too much, one with room takes."""
    size = [sum(len(t[2]) for t in pieces) for pieces in filled]
    spill: list[tuple] = []
    for pieces, n in zip(filled, size, strict=True):
        while n > capacity:
            doc_id, start, ids, total = pieces.pop()
            cut = min(n - capacity, len(ids))
            if cut < len(ids):
                pieces.append((doc_id, start, ids[:-cut], total))
            spill.append((doc_id, start + len(ids) - cut, ids[-cut:], total))
            n -= cut
    for pieces, n in zip(filled, size, strict=True):
        while n < capacity:
            doc_id, start, ids, total = spill.pop()
            take = min(capacity - n, len(ids))
            pieces.append((doc_id, start, ids[:take], total))
            if take < len(ids):
                spill.append((doc_id, start + take, ids[take:], total))
            n += take
    return filled


class Packer:
    """Packs one stream of documents; ``add`` and ``finish`` return finished pieces as tuples in the schema's order."""

    def __init__(self, capacity: int, first_sequence: int, block_tokens: int = BLOCK_TOKENS):
        self.capacity, self.next, self.limit = capacity, first_sequence, block_tokens
        self.tails: list[tuple] = []
        self.held = 0
        self.out: list[tuple] = []

    def _emit(self, pieces: list[tuple], length: int) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, len(ids), unsigned_crc32(ids.astype("<u4").tobytes()), total, self.next, at, length))
            at += len(ids)
        self.next += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        c, n = self.capacity, len(ids)
        whole = n // c * c
        for a in range(0, whole, c):
            self._emit([(doc_id, a, ids[a : a + c], n)], c)
        if whole < n:
            self.tails.append((doc_id, whole, ids[whole:].copy(), n))
            self.held += n - whole
        if self.held >= self.limit:
            self.pack()

    def pack(self, last: bool = False) -> None:
        """Packs the block in full windows; what fills no window stays for the next one, or is padded if this is the last."""
        c = self.capacity
        count = self.held // c
        tails, self.tails = self.tails, []
        over = self.held - count * c
        while over:  # the last documents wait for the next block
            doc_id, start, ids, total = tails.pop()
            take = min(over, len(ids))
            if take < len(ids):
                tails.append((doc_id, start, ids[:-take], total))
            self.tails.append((doc_id, start + len(ids) - take, ids[-take:], total))
            over -= take
        self.tails.reverse()
        self.held = sum(len(t[2]) for t in self.tails)
        if count:
            for pieces in levelled(near_equal(tails, count), c):
                self._emit(pieces, c)
        if last and self.tails:
            self._close(self.tails)
            self.tails, self.held = [], 0

    def _close(self, pieces: list[tuple]) -> None:
        """The stream's last tokens: powers of two from the capacity's half down are taken off while that halves the padding or more."""
        n = sum(len(p[2]) for p in pieces)
        power = 1 << max(0, n.bit_length() - 1)
        while n and power >= 64 and n < self.capacity:
            if n >= power:
                cut, got = [], 0
                while got < power:
                    doc_id, start, ids, total = pieces.pop(0)
                    take = min(power - got, len(ids))
                    cut.append((doc_id, start, ids[:take], total))
                    if take < len(ids):
                        pieces.insert(0, (doc_id, start + take, ids[take:], total))
                    got += take
                self._emit(cut, power)
                n -= power
            power >>= 1
        if pieces:
            self._emit(pieces, self.capacity if n & (n - 1) else n)

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


#: Sequence numbers that a row's place leaves for itself: more than a text of 2^31 bytes fills at 128 tokens or more each.
PLACE_BITS = 24


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 1, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text", place: Column | None = None) -> DataFrame:
    """All documents packed; one row a piece, ``sequence_length`` being the padded length of its sequence."""
    modest_batches(docs.sparkSession)
    placed = [] if place is None else [place.cast("long").alias("place")]

    def work(batches):
        enc = encoder(tokenizer)
        packer, due = Packer(capacity, TaskContext.get().partitionId() << 36, block_tokens), None
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        rows = lambda got: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*got, strict=True)], names=names)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            places = batch.column(2).to_pylist() if batch.num_columns > 2 else None
            for a, ids, ends in enc.encode_column(batch.column(1), end_id):
                for k in range(len(ends) - 1):
                    if places:
                        if places[a + k] != due:
                            packer.pack(last=True)
                            packer.next = places[a + k] << PLACE_BITS
                        due = places[a + k] + 1
                    packer.add(keys[a + k], ids[ends[k] : ends[k + 1]])
                if len(packer.out) >= 4096:
                    yield rows(packer.take())
        packer.pack(last=True)
        if packer.out:
            yield rows(packer.take())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *placed).mapInArrow(trimmed(work, keeps=("encoders",)), SCHEMA)

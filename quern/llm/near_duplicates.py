"""Near duplicates on word shingles: HyperMinHash registers, banding, collision-corrected estimates, exact checks.

A document's set is its distinct runs of five words (A-Z lower-cased; words are runs of bytes other than space and
0x09-0x0D); with one to four words the whole sequence is its only shingle; without words the set is empty.  Documents
are linked when 100 |A and B| >= 85 |A or B| on the full sets (``threshold``; the pipeline takes 80), and a component is
what links connect.

1. One pass makes, per document, the set's size, its 128-bit fingerprint and its HyperMinHash: 256 buckets by the top
   8 bits of a shingle's hash, each keeping of its smallest hash the count of leading zeros (6 bits) and the 10 bits
   after the leading one.
2. Documents with the same fingerprint have the same set; only one representative of each set goes on.
3. Registers are cut in bands of six.  Two sets of Jaccard similarity 0.85 share none of 42 bands with a probability
   of (1 - 0.85^6)^42, below 3e-9 (of 0.80: below 3e-6).  In each band value that several sets share, the one that meets most
   others leads, and the others are held against it: pairs grow with rows, not with their square.
4. Sets that reach the threshold with a leader are linked; then, in band values whose sets are still in several
   components, the pairs across components that an exact bound leaves possible are held against each other, so a link
   that no leader shows is found as well.
5. A pair with a leader goes on when the registers' Jaccard estimate, less the collisions expected of registers so
   short, is within five standard errors of the threshold; it is then confirmed on the full sets of both texts.  Pairs
   across components have passed the exact bound and are confirmed at once.

Defined results: null or blank text is an empty set, linked with nothing.  Rows of one ``doc_id`` are one document.
A null ``doc_id`` links with nothing: its component is null and it is kept (``without_copies`` then drops whole copies
among repeated rows and rows of null id, as the pipeline does).  Other columns are not read.

At scale: counts and leaders are map-side combined; joins of ids back to members are sort-merge joins that AQE may split;
texts are confirmed in streams of bounded size, a leader of many pairs in many streams; components are found by alternating large and small stars over stored edge tables; nothing per document reaches the
driver.  Texts of documents in no candidate pair are dropped before their shuffle by a bitmap of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quern.llm.storage import discard, modest_batches, own_prefix, stored
from quern.llm.textcore import Words, chunks, mix, text_buffers, trimmed

SHINGLE = 5
BUCKET_BITS, ZERO_BITS, MANTISSA_BITS = 8, 6, 10
BUCKETS = 1 << BUCKET_BITS
BANDS, ROWS = 42, 6
EMPTY = 0xFFFF
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document, one after another, and n+1 offsets."""
    words = Words(data, offsets)
    h, first, n_docs = words.hash, words.first, len(offsets) - 1
    n = len(h)
    total = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        total[: max(0, n - j)] += h[j:] * _MULTIPLIERS[j]
    grams, count = mix(total), np.diff(first)
    short = (count > 0) & (count < SHINGLE)
    for d in np.flatnonzero(short):
        seq = h[first[d] : first[d + 1]]
        grams[first[d]] = mix((seq * _MULTIPLIERS[: len(seq)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(seq)))[0]
    sizes = np.where(short, 1, np.maximum(0, count - SHINGLE + 1))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    flat = grams[np.repeat(first[:-1] - ends[:-1], sizes) + np.arange(ends[-1])]
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        flat[a:b].sort()
    fresh = np.ones(len(flat), bool)
    fresh[1:] = flat[1:] != flat[:-1]
    fresh[ends[:-1][sizes > 0]] = True
    return flat[fresh], np.concatenate(([0], np.cumsum(fresh)))[ends] if n_docs else np.zeros(1, np.int64)


def registers(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """HyperMinHash of each set: (documents, 256) registers of 16 bits, all ones where a bucket is empty."""
    n_docs = len(ends) - 1
    out = np.full((n_docs, BUCKETS), EMPTY, np.uint16)
    doc = np.repeat(np.arange(n_docs), np.diff(ends))
    bucket = (flat >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    cell = doc * BUCKETS + bucket
    lead = np.ones(len(cell), bool)
    lead[1:] = cell[1:] != cell[:-1]  # sets are sorted, so the first of a bucket is its smallest
    rest = flat[lead] << np.uint64(BUCKET_BITS)
    zeros = 53 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
    zeros = np.minimum(zeros, (1 << ZERO_BITS) - 2)
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    out.reshape(-1)[cell[lead]] = (zeros.astype(np.uint16) << np.uint16(MANTISSA_BITS)) | mantissa.astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and the buckets that each rests on."""
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(1)
    cells = np.maximum(1, used.sum(1))
    small, large = np.minimum(n_a, n_b).astype(float), np.maximum(1, np.maximum(n_a, n_b)).astype(float)
    ratio = large / np.maximum(small, 1)
    chance = 0.169919487159739 * 2.0**-MANTISSA_BITS * 4 * ratio / (1 + ratio) ** 2
    return (same / cells - chance) / (1 - chance), cells


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, fingerprint of the set (16 bytes), registers (512 bytes)."""

    def work(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets):
                flat, ends = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                regs = registers(flat, ends).astype("<u2")
                prints = [xxhash.xxh3_128_digest(flat[x:y].tobytes()) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(ends)), pa.array(prints, pa.binary()), pa.array([r.tobytes() for r in regs], pa.binary())], names=["doc_id", "n_shingles", "fp", "regs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(work), "doc_id long, n_shingles long, fp binary, regs binary")


def band_values(reps: DataFrame) -> DataFrame:
    """(key, rep, n): one row per representative and band with at least one filled register; n is the set's size."""
    width = 2 * ROWS
    part = lambda i: F.col("regs").substr(i * width + 1, F.lit(width))
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.when(part(i) != F.lit(b"\xff" * width), F.xxhash64(i, part(i))))
    return reps.select("rep", "n", F.explode(keys).alias("key")).where("key is not null").select("key", "rep", "n")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge table (a, b)."""
    both = lambda e: e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(e.select("b", "a"))
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = state(edges)
    while True:
        near = both(edges)  # large star: every larger neighbour goes to the smallest neighbour
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))  # small star: smaller neighbours and the node itself
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b")))
        last, edges = edges, stored(small.where("a <> b").distinct(), "edges")
        discard(last)
        after = state(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = after


def bitmap_mark(docs: DataFrame, ids: DataFrame, id_col: str, hit: str, max_bits: int = 1 << 28) -> DataFrame:
    """``docs`` with a column named ``hit``: true for all rows of ``ids`` (a column ``id``) and few others.

    The bitmap has ``max_bits`` at most, so its broadcast is bounded whatever the data; more ids only make it less sharp.
    """
    n, own = ids.count(), own_prefix(docs)
    p, bucket, bitmap = own + "p", own + "bucket", own + "map"
    bits = min(max_bits, max(1 << 15, 1 << math.ceil(math.log2(16 * n + 1))))
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits))
    made = ids.select(place(F.col("id")).alias("p")).groupBy(F.bitmap_bucket_number("p").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(bitmap))
    at = F.bitmap_bit_position(p)
    byte = F.conv(F.hex(F.col(bitmap).substr((F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0
    marked = docs.withColumn(p, place(F.col(f"`{id_col}`"))).withColumn(bucket, F.bitmap_bucket_number(p))
    marked = marked.join(F.broadcast(made), bucket, "left")
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(bit, F.lit(False)).alias(hit))


def bitmap_filter(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id's bit is set."""
    hit = own_prefix(docs) + "hit"
    return bitmap_mark(docs, ids, id_col, hit).where(hit).drop(hit)


def close_pairs(pairs: DataFrame, reps: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose sizes and registers allow the threshold (in hundredths)."""
    side = lambda c: reps.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))

    def work(batches):
        t = threshold / 100
        for batch in batches:
            if batch.num_rows:
                cols = batch.to_pydict()
                a, b = (np.frombuffer(b"".join(cols[c]), "<u2").reshape(-1, BUCKETS) for c in ("regs_a", "regs_b"))
                guess, cells = estimate(a, b, np.array(cols["n_a"]), np.array(cols["n_b"]))
                yield batch.select(["a", "b"]).filter(pa.array(guess >= t - 5 * np.sqrt(t * (1 - t) / cells)))

    return sized.mapInArrow(trimmed(work), "a long, b long")


#: A leader with more pairs, or a band value with more open sets, is split; tables of such keys have at most ``MOST_HEAVY`` rows.
LEADER_PAIRS, OPEN_SETS, MOST_HEAVY = 1024, 2048, 1 << 20


def heavy(counts: DataFrame, total: int, most: int) -> DataFrame:
    """Of a table (.., n) of how often each key stands in ``total`` rows, the keys above ``most``, for a broadcast.

    Where ``most`` would leave more than 2^20 keys the cut is higher, so the table is small whatever the data.
    """
    return stored(counts.where(F.col("n") > max(most, math.ceil(total / MOST_HEAVY))), "heavy")


def led(pairs: DataFrame) -> DataFrame:
    """(leader, salt, member): the end on more pairs leads, and its pairs are parted so that no (leader, salt) has many."""
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    common = heavy(degree, 2 * pairs.count(), LEADER_PAIRS)
    for end in ("a", "b"):
        pairs = pairs.join(F.broadcast(common.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"))), end, "left")
    n_a, n_b = F.coalesce("n_a", F.lit(0)), F.coalesce("n_b", F.lit(0))
    first, most = F.struct(n_a, F.col("a")) >= F.struct(n_b, F.col("b")), F.greatest(n_a, n_b)
    pairs = pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("leader"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("member"), F.greatest(F.lit(1), F.ceil(most / LEADER_PAIRS)).alias("parts"))
    return pairs.select("leader", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("salt"), "member")


class Leader:
    """The sets of the leader whose members are passing by."""

    def __init__(self):
        self.key, self.sets = None, {}

    def add(self, key: tuple[int, int], shingles: np.ndarray) -> None:
        if key != self.key:
            self.key, self.sets = key, {}
        if len(shingles):
            self.sets[xxhash.xxh3_128_digest(shingles.tobytes())] = shingles.copy()

    def reached(self, key: tuple[int, int], flat: np.ndarray, ends: np.ndarray, threshold: int) -> np.ndarray:
        """Which of the members' sets, one after another in ``flat``, reach the threshold with one of the leader's."""
        sizes, hit = np.diff(ends), np.zeros(len(ends) - 1, bool)
        for p in self.sets.values() if key == self.key else ():
            at = np.minimum(np.searchsorted(p, flat), len(p) - 1)
            both = np.diff(np.concatenate(([0], np.cumsum(p[at] == flat)))[ends])
            hit |= (sizes > 0) & (100 * both >= threshold * (len(p) + sizes - both))
        return hit


def confirmed(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold; ``docs`` is (doc_id, text).

    A leader's text travels once per part of its pairs, ahead of its members' texts, which stream past it: a worker
    holds the leader's set and one chunk of members, however many there are.
    """
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    parted = stored(led(pairs), "led")
    heads = parted.select("leader", "salt", F.col("leader").alias("doc_id"), F.lit(0).alias("kind")).distinct()
    rows = heads.unionAll(parted.select("leader", "salt", F.col("member").alias("doc_id"), F.lit(1).alias("kind"))).join(bitmap_filter(docs, ids, "doc_id"), "doc_id")
    rows = rows.select("leader", "salt", "kind", "doc_id", "text").repartition("leader", "salt").sortWithinPartitions("leader", "salt", "kind")

    def work(batches):
        lead = Leader()
        for batch in batches:
            leader, salt, kind = (batch.column(k).to_numpy() for k in range(3))
            turn = np.flatnonzero((np.diff(leader) != 0) | (np.diff(salt) != 0) | (np.diff(kind) != 0)) + 1
            keep = np.zeros(len(leader), bool)
            data, offsets = text_buffers(batch.column(4))
            for x, y in zip([0, *turn.tolist()], [*turn.tolist(), len(leader)], strict=True):
                for a, b in chunks(offsets[x : y + 1]) if y > x else ():
                    a, b, key = a + x, b + x, (int(leader[x]), int(salt[x]))
                    flat, ends = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    if kind[x]:
                        keep[a:b] = lead.reached(key, flat, ends, threshold)
                    else:
                        for k in range(b - a):
                            lead.add(key, flat[ends[k] : ends[k + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["a", "b"]).filter(pa.array(keep))

    links = stored(rows.mapInArrow(trimmed(work), "a long, b long"), "links")
    discard(parted)
    return links


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def led_bands(reps: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Band values that several sets share, as (key, rep, n, size); and the pairs (a, b) of their sets and leaders whose sizes allow the threshold.

    The leader of a band value is its set that meets most others over all bands: of a text and its altered copies
    this is the text, to which copies are closer than to each other.
    """
    bands = band_values(reps)
    shared = stored(bands.join(bands.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "key"), "bands")
    known = shared.groupBy("rep").agg(F.sum("size").alias("met"))
    led = shared.join(known, "rep").groupBy("key").agg(F.max_by(F.struct("rep", "n"), F.struct("met", F.xxhash64("rep"))).alias("l"))
    led = led.select("key", F.col("l.rep").alias("leader"), F.col("l.n").alias("leader_n"))
    fits = (F.col("rep") != F.col("leader")) & (100 * F.least("n", "leader_n") >= threshold * F.greatest("n", "leader_n"))
    return shared, stored(shared.join(led, "key").where(fits).select(*_pair(F.col("rep"), F.col("leader"))).distinct(), "pairs")


SKETCH_LONGS = 16


def odd_sketches(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(documents, 16) longs: of 1024 bits, each is the parity of the shingles that hash to it.

    The exclusive or of two sketches is the sketch of the sets' symmetric difference, so its number of ones is at most
    the size of that difference: an exact bound, not an estimate.
    """
    n_docs, bits = len(ends) - 1, 64 * SKETCH_LONGS
    cell = np.repeat(np.arange(n_docs) * bits, np.diff(ends)) + (mix(flat) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(cell, minlength=n_docs * bits) & 1).astype(np.uint8).reshape(n_docs, bits)
    return np.packbits(odd, axis=1).view(np.int64)


def sketches(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(rep, s0 ... s15) of the documents in ``ids``."""

    def work(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in chunks(offsets):
                made = odd_sketches(*shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(np.ascontiguousarray(made[:, k])) for k in range(SKETCH_LONGS)]], names=["rep", *(f"s{k}" for k in range(SKETCH_LONGS))])

    texts = bitmap_filter(docs, ids, "doc_id").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    return texts.mapInArrow(trimmed(work), "rep long, " + ", ".join(f"s{k} long" for k in range(SKETCH_LONGS)))


def open_pairs(shared: DataFrame, part: DataFrame, docs: DataFrame, threshold: int, twice: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs (a, b), not yet tried, of sets that share a band value, lie in different components, and may reach the threshold.

    With d the ones in the exclusive or of two odd sketches, the sets differ in d shingles at least, so their similarity
    is at most (|A| + |B| - d) / (|A| + |B| + d).  Texts altered beyond the threshold are ruled out inside the join, and
    no true link is.  Documents of several texts have no one sketch and are always held against each other.  One side of a
    band value with many open sets is parted, so its comparisons are many tasks' work.
    """
    placed = stored(shared.where("size > 2").join(part, shared["rep"] == part["node"], "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component")), "placed")
    split = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    open_sets = stored(placed.join(split, "key"), "open")
    made = sketches(open_sets.select(F.col("rep").alias("id")).distinct(), docs).join(twice.select(F.col("doc_id").alias("rep")), "rep", "left_anti")
    common = heavy(open_sets.groupBy("key").agg(F.count("*").alias("n")), open_sets.count(), OPEN_SETS).select("key", F.ceil(F.col("n") / OPEN_SETS).alias("parts"))
    rows = open_sets.join(made, "rep", "left").join(F.broadcast(common), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x, y = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), "parts")).alias("x"), rows.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).alias("y")
    differ = " + ".join(f"bit_count(x.s{k} ^ y.s{k})" for k in range(SKETCH_LONGS))
    # threshold: 100 (m - d) >= t (m + d) for m = |A| + |B|; a missing sketch rules nothing out
    may = f"coalesce({100 - threshold} * (x.n + y.n) >= {100 + threshold} * ({differ}), true)"
    pairs = x.join(y, F.expr(f"x.key = y.key and x.salt = y.salt and x.component < y.component and {may}")).select(*_pair(F.col("x.rep"), F.col("y.rep"))).distinct()
    across = stored(pairs.join(tried, ["a", "b"], "left_anti"), "across")
    discard(placed, open_sets)
    return across


def near_duplicates(docs: DataFrame, threshold: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    modest_batches(docs.sparkSession)
    sigs = stored(signatures(docs), "signatures")
    known = sigs.where("doc_id is not null and n_shingles > 0")
    reps = stored(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.first("regs").alias("regs")), "representatives")
    shared, first = led_bands(reps, threshold)
    close = stored(close_pairs(first, reps, threshold), "close")
    links = confirmed(close, docs, threshold)
    member = known.select("doc_id", "fp").join(reps.select("fp", "rep"), "fp").select("doc_id", "rep")
    twice = member.groupBy("doc_id").agg(F.min("rep").alias("m"), F.max("rep").alias("top")).where("m < top")
    again = member.join(twice, "doc_id").select(F.col("rep").alias("a"), F.col("m").alias("b")).unionAll(member.where("doc_id <> rep").join(twice, "doc_id").select("doc_id", "rep"))
    links = links.unionAll(again)
    part = components(links)
    across = open_pairs(shared, part, docs, threshold, twice, first)
    more = confirmed(across, docs, threshold)
    discard(shared, first, close, across)
    if not more.isEmpty():
        part = components(links.unionAll(more))
    placed = member.join(part, member["rep"] == part["node"], "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    return sigs.select("doc_id", "n_shingles").join(placed, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), (F.col("doc_id").isNull() | (F.coalesce("component_id", "doc_id") == F.col("doc_id"))).alias("kept"))


def survivors(docs: DataFrame, found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that are kept: one document of each component, the one of smallest id, and all of null id.

    Only rows whose id's bit is set are shuffled and held against the dropped ids; the others stay where they are.
    """
    own = own_prefix(docs)
    hit, gone = own + "hit", own + "gone"
    drop = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct(), "dropped")
    marked = bitmap_mark(docs, drop, id_col, hit)
    checked = marked.where(hit).join(drop.withColumnRenamed("id", gone), F.col(f"`{id_col}`") == F.col(gone), "left_anti")
    return marked.where(f"not {hit}").unionByName(checked).drop(hit)


def fingerprinted(docs: DataFrame, text_col: str, fp: str) -> DataFrame:
    """``docs`` with a column named ``fp``, the fingerprint of the text's shingle set; null for the empty set."""
    schema = StructType([*docs.schema.fields, StructField(fp, BinaryType())])

    def work(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text_col)))
            for a, b in chunks(offsets):
                flat, ends = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                prints = [xxhash.xxh3_128_digest(flat[x:y].tobytes()) if y > x else None for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(prints, pa.binary())], names=[*batch.schema.names, fp])

    return docs.mapInArrow(trimmed(work), schema)


def without_copies(left: DataFrame, docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``left``, the survivors of ``docs``, less whole copies that ids don't tell apart.

    Of the rows of one id and one shingle set, one stays (the smallest by all columns).  A row of null id goes if a row
    with an id has its set; of rows of null id with one set, one stays.  Blank texts of null id are linked with nothing
    and stay.  Rows of one id with different sets are one document of several texts, and all stay.

    Only rows of repeated or null ids (and a few whose bit is set by chance) are shuffled, combined in the map first;
    other rows' sets are made again only where non-blank texts of null id must be held against them.
    """
    again = stored(found.where("kept and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id"), "again")
    nameless = not found.where("doc_id is null and n_shingles > 0").isEmpty()
    if again.isEmpty() and not nameless:
        return left
    ident, names, own = F.col(f"`{id_col}`"), left.columns, own_prefix(left)
    hit, fp = own + "hit", own + "fp"
    plain = [c for c in names if left.schema[c].dataType.typeName() not in ("map", "variant")]
    marked = bitmap_mark(left, again, id_col, hit)
    # written once: the rows go three ways, and whole rows are compared
    some = stored(fingerprinted(marked.where(F.col(hit) | ident.isNull()).drop(hit), text_col, fp), "again-rows")
    whole = lambda cols: F.struct(*[F.col(f"`{c}`") for c in cols])
    first = lambda rows, *by: stored(rows.groupBy(*by).agg(F.min_by(whole(names), whole(plain)).alias(own + "row")), "first-rows")
    out = marked.where(~F.col(hit) & ident.isNotNull()).drop(hit)
    out = out.unionByName(first(some.where(ident.isNotNull()), ident.alias(own + "id"), fp).select(f"{own}row.*"))
    bare = some.where(ident.isNull())
    out = out.unionByName(bare.where(F.col(fp).isNull()).drop(fp))
    if nameless:
        known = fingerprinted(docs.where(ident.isNotNull()).select(F.col(f"`{text_col}`")), text_col, fp).select(fp).where(F.col(fp).isNotNull()).distinct()
        out = out.unionByName(first(bare.where(F.col(fp).isNotNull()), fp).join(known, fp, "left_anti").select(f"{own}row.*"))
    return out

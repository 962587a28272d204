"""Mixing sources to target weights by Pfair scheduling, with Spark expressions only.

Rows of a source are shuffled by a hash and cut into blocks.  With whole-number weights a_i of sum A, block j of source
i gets the release time floor(j A / a_i) and the deadline ceil((j + 1) A / a_i), and each slot of time goes to the
released block of earliest deadline.  On one line of slots this meets every deadline, so before any slot t a source has
had more than t a_i / A - 1 and fewer than t a_i / A + 1 blocks.  The schedule repeats after A slots, so one period is
simulated, by an ``aggregate`` over its slots in one row.  Sources of one weight have the same times and take turns, so
a slot looks at one candidate per distinct weight, of which there are fewer than sqrt(2 A).  The bound holds until the
first source runs out; after that its slots are left out, and the others keep their order and relative weights.

No row is dropped, repeated or sampled.  Weights: a mapping of source to weight, or, by default, the source's share of
rows to the power ``alpha`` (tempered sampling).  The period A is at least ``period``, and so long that the smallest
weight is 16 slots, but about 2^17 at most: whole-number weights are within about a sixteenth of their targets, or of one part
in 2^17 if that is more.

Defined results: a null source is the source ''; a source without a given weight gets the smallest given one; repeated
rows are separate rows; null ids are ids like others; an empty table gives no rows.  Extra columns stay as they are,
whatever their names, but ``positions`` puts the schedule in the place of columns named mix_block, mix_slot, mix_release,
mix_deadline and mix_position.

At scale: a row's number in its source comes from counts of hash buckets of bounded size (the hash is of the whole row,
so rows of one id or none are spread), so a source with a third of all rows is numbered by as many tasks as any other
rows.  Rows are shuffled once for their numbers, and once more for their order by ``mixed``; the places of blocks are
running sums over one small row per block.  What is broadcast is one period, 2^17 rows or so at most, and one row per
written part.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.storage import own_prefix, stored

BUCKET_ROWS, MOST_SLOTS, LEAST_SLOTS, BLOCKS_PER_TASK = 1024, 1 << 17, 16, 1 << 16


def sources_table(counts: DataFrame, weights: Mapping[str, float] | None, alpha: float, period: int) -> DataFrame:
    """One row: arrays of sources, row counts and whole-number weights, in the sources' order; and their sum.  ``counts`` is (source, n)."""
    if weights:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
        raw = F.coalesce(F.try_element_at(given, F.col("source")).cast("double"), F.lit(float(min(weights.values()))))
    else:
        raw = F.pow(F.col("n").cast("double"), F.lit(alpha))
    one = counts.select("source", "n", raw.alias("w")).agg(F.array_sort(F.collect_list(F.struct("source", "n", "w"))).alias("s")).where(F.size("s") > 0)
    one = one.withColumn("total", F.aggregate("s", F.lit(0.0), lambda a, x: a + x["w"])).withColumn("least", F.array_min(F.transform("s", lambda x: x["w"])))
    one = one.withColumn("slots", F.greatest(F.lit(period), F.size("s"), F.least(F.lit(MOST_SLOTS), F.ceil(F.col("total") / F.col("least") * LEAST_SLOTS))))
    share = lambda x: F.greatest(F.lit(1), F.round(x["w"] / F.col("total") * F.col("slots"))).cast("long")
    one = one.select(F.transform("s", lambda x: x["source"]).alias("names"), F.transform("s", lambda x: x["n"]).alias("n"), F.transform("s", share).alias("share"))
    return one.withColumn("period", F.aggregate("share", F.lit(0).cast("long"), lambda t, x: t + x))


def release(j: Column, a: Column, total: Column) -> Column:
    return F.floor(j * total / a)


def deadline(j: Column, a: Column, total: Column) -> Column:
    return F.ceil((j + 1) * total / a)


def schedule(sources: DataFrame) -> DataFrame:
    """One row per slot of a period: slot, the source's name, its block's number j, the source's rows n and weight, the period."""
    whole = lambda n, d: F.floor(n / d)  # noqa: E731  numbers are far below 2^53
    index = F.sequence(F.lit(0), F.size("share") - 1)
    alike = lambda a: F.struct(a.alias("a"), F.filter(index, lambda i: F.get("share", i) == a).alias("who"))
    sources = sources.withColumn("classes", F.transform(F.array_sort(F.array_distinct("share")), alike))
    sources = sources.withColumn("classes", F.transform("classes", lambda x: F.struct(x["a"], x["who"], F.size(x["who"]).cast("long").alias("m"))))
    total = F.col("period")

    def ready(done: Column, t: Column) -> Column:
        """The released block of earliest deadline: its deadline, source, j and class."""
        each = F.transform("classes", lambda x, c: F.struct(x["a"].alias("a"), whole(F.get(done, c), x["m"]).alias("j"), F.get(x["who"], (F.get(done, c) % x["m"]).cast("int")).alias("i"), c.alias("c")))
        may = F.filter(each, lambda x: (x["j"] < x["a"]) & (whole(x["j"] * total, x["a"]) <= t))
        return F.array_min(F.transform(may, lambda x: F.struct(whole((x["j"] + 1) * total + x["a"] - 1, x["a"]).alias("due"), x["i"], x["j"], x["c"])))

    order = "array<struct<i:int,j:bigint>>"
    start = lambda done: F.struct(done.alias("done"), F.array().cast(order).alias("order"))
    given = lambda s, p: F.struct(F.transform(s["done"], lambda x, c: F.when(c == p["c"], x + 1).otherwise(x)).alias("done"), F.array_append(s["order"], F.struct(p["i"].alias("i"), p["j"].alias("j"))).alias("order"))
    step = lambda s, t: F.transform(F.array(ready(s["done"], t)), lambda p: given(s, p))[0]  # noqa: E731  binds the choice once
    # lists grow by appending inside a stretch of about sqrt(A) slots, and by one stretch at a time
    width = F.ceil(F.sqrt(total)).cast("long")
    stretch = lambda k: F.sequence(k * width, F.least(k * width + width, total) - 1)
    joined = lambda s, got: F.struct(got["done"].alias("done"), F.concat(s["order"], got["order"]).alias("order"))
    longer = lambda s, k: F.transform(F.array(F.aggregate(stretch(k), start(s["done"]), step)), lambda got: joined(s, got))[0]
    none = F.transform("classes", lambda x: F.lit(0).cast("long"))
    ran = F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(total / width) - 1), start(none), longer)
    slots = sources.select("names", "n", "share", "period", F.posexplode(ran["order"]).alias("slot", "o"))
    return slots.select(F.col("slot").cast("long").alias("slot"), F.get("names", F.col("o.i")).alias("source"), F.col("o.j").alias("j"), F.get("n", F.col("o.i")).alias("n"), F.get("share", F.col("o.i")).alias("share"), "period")


def _block_places(plan: DataFrame, block_rows: int) -> DataFrame:
    """source, block, slot, start (rows before the block in the whole order), share, period: one row per block."""
    sources = plan.where("j = 0").select("source", "n", "share", "period")
    last = F.floor((F.col("n") - 1) / block_rows)
    some = sources.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / BLOCKS_PER_TASK)))).repartition("source", "part")
    blocks = some.withColumn("block", F.explode(F.sequence(F.col("part") * BLOCKS_PER_TASK, F.least((F.col("part") + 1) * BLOCKS_PER_TASK - 1, last))))
    blocks = blocks.withColumn("j", F.col("block") % F.col("share")).join(F.broadcast(plan.select("source", "j", F.col("slot").alias("turn"))), ["source", "j"])
    size = F.least(F.lit(block_rows), F.col("n") - F.col("block") * block_rows)
    blocks = blocks.select("source", "block", "share", "period", (F.floor(F.col("block") / F.col("share")) * F.col("period") + F.col("turn")).alias("slot"), size.cast("long").alias("size"))
    # written in the order of slots, so that parts and running sums in them are the same for every later job
    blocks = stored(blocks.repartitionByRange("slot").sortWithinPartitions("slot"), "blocks").withColumn("file", F.col("_metadata.file_path"))
    at, before = 0, []
    for r in sorted(blocks.groupBy("file").agg(F.min("slot").alias("first"), F.sum("size").alias("size")).collect(), key=lambda r: r["first"]):
        before.append((r.file, at))
        at += r.size
    # as an Arrow table: rows of Python objects would pass through Python workers of their own kind on every executor
    names, places = zip(*before, strict=True) if before else ((), ())
    before = plan.sparkSession.createDataFrame(pa.table({"file": pa.array(names, pa.string()), "before": pa.array(places, pa.int64())}))
    inside = F.sum("size").over(Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return blocks.join(F.broadcast(before), "file").select("source", "block", "slot", (F.col("before") + inside).alias("start"), "share", "period")


def positions(docs: DataFrame, weights: Mapping[str, float] | None = None, alpha: float = 0.5, block_rows: int = 64, period: int = 1000, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with mix_block, mix_release, mix_deadline, mix_slot and the unique mix_position from 0."""
    own, placed = _placed(docs, weights, alpha, block_rows, period, id_col, source_col)
    made = [c.removeprefix(own) for c in placed.columns if c.startswith(own)]
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns if c not in made], *[F.col(own + c).alias(c) for c in made])


def _placed(docs: DataFrame, weights: Mapping[str, float] | None, alpha: float, block_rows: int, period: int, id_col: str, source_col: str) -> tuple[str, DataFrame]:
    """A prefix, and ``docs`` with the schedule's columns named with it."""
    of, own = lambda c: F.col(f"`{c}`"), own_prefix(docs)
    hashed = F.xxhash64(*[of(c) for c in docs.columns if not _has_map(docs.schema[c].dataType)])
    source = F.coalesce(of(source_col).cast("string"), F.lit(""))
    keyed = docs.select(source.alias("source"), hashed.alias("hash"))
    counts = stored(keyed.groupBy("source").agg(F.count("*").alias("n")), "sources")
    total = counts.agg(F.sum("n")).first()[0] or 0
    bucket = lambda h: F.pmod(F.shiftright(h, 8), F.lit(max(1, math.ceil(total / BUCKET_ROWS))))
    plan = stored(schedule(sources_table(counts, weights, alpha, period)), "schedule")
    sizes = keyed.withColumn("bucket", bucket("hash")).groupBy("source", "bucket").agg(F.count("*").alias("size"))
    first = sizes.select("source", "bucket", "size", (F.sum("size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("size")).alias("first"))
    touched = first.select("source", "bucket", "first", F.explode(F.sequence(F.floor(F.col("first") / block_rows), F.floor((F.col("first") + F.col("size") - 1) / block_rows))).alias("block"))
    places = touched.join(_block_places(plan, block_rows), ["source", "block"]).groupBy("source", "bucket", "first", "share", "period").agg(F.array_sort(F.collect_list(F.struct("block", "start", "slot"))).alias("blocks"))
    places = places.toDF(*[own + c for c in places.columns])
    mine = lambda c: F.col(own + c)
    rows = docs.withColumns({own + "source": source, own + "hash": hashed}).withColumn(own + "bucket", bucket(own + "hash"))
    order = Window.partitionBy(own + "source", own + "bucket").orderBy(own + "hash", of(id_col))
    rows = rows.withColumn(own + "rank", F.row_number().over(order) - 1).join(places, [own + "source", own + "bucket"]).withColumn(own + "rank", mine("rank") + mine("first"))
    rows = rows.withColumn(own + "at", F.get(mine("blocks"), (F.floor(mine("rank") / block_rows) - mine("blocks")[0]["block"]).cast("int")))
    block = mine("at")["block"]
    j, cycle = block % mine("share"), F.floor(block / mine("share")) * mine("period")
    made = {
        "mix_block": block, "mix_slot": mine("at")["slot"], "mix_release": cycle + release(j, mine("share"), mine("period")),
        "mix_deadline": cycle + deadline(j, mine("share"), mine("period")), "mix_position": mine("at")["start"] + mine("rank") % block_rows,
    }
    return own, rows.select(*[of(c) for c in docs.columns], *[v.cast("long").alias(own + k) for k, v in made.items()])


def _has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType)) or isinstance(kind, T.ArrayType) and _has_map(kind.elementType)


def mixed(docs: DataFrame, rows_per_partition: int = 8192, weights: Mapping[str, float] | None = None, alpha: float = 0.5, block_rows: int = 64, period: int = 1000, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` in mixed order: partition p holds positions p * rows_per_partition and on, in order."""
    n = max(1, math.ceil(docs.count() / rows_per_partition))
    own, placed = _placed(docs, weights, alpha, block_rows, period, id_col, source_col)
    dealt = placed.repartitionById(n, F.floor(F.col(own + "mix_position") / rows_per_partition).cast("int"))
    return dealt.sortWithinPartitions(own + "mix_position").select(*[F.col(f"`{c}`") for c in docs.columns])

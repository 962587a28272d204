"""Chat formatting with Spark expressions only.

A conversation's turn structs are collected and sorted; adjacent turns of one role are merged under one header; texts
are escaped and joined.  The template:

    <turn ROLE>TEXT<sep/>TEXT</turn>\\n

``&`` and ``<`` in texts are written ``&amp;`` and ``&lt;`` (in roles ``>`` as ``&gt;`` too), so no text can hold a
control string, and reading back undoes exactly that.  ``mask`` lists the stretches (start, length, in code points of
the formatted string) that a loss is taken over: each assistant text, without headers, separators and ends.

Defined results: null text and null role are empty; null ``conv_id`` is a conversation of its own; turns with equal
``turn`` follow by role, then text, and repeated rows are repeated turns; null turns come first.  Other columns are not
read.  At scale: one shuffle by conversation; a conversation is one output row, so it meets in one task as its result
does; array steps are linear in the number of turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import stored

SEPARATOR, END = "<sep/>", "</turn>\n"
_BLOCK = 64


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;")) if role else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is evaluated once, whatever lambdas it appears in."""
    return F.transform(F.array(value), use)[0]


def running_sum(values: Column) -> Column:
    """Sums of all elements before each element of a bound array, from sums of blocks and sums inside a block."""
    zero, add = F.lit(0).cast("long"), lambda s, x: s + x
    whole = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / _BLOCK).cast("int")), lambda b: F.aggregate(F.slice(values, b * _BLOCK + 1, F.lit(_BLOCK)), zero, add))
    grown = let(whole, lambda w: F.aggregate(w, F.array(zero), lambda s, x: F.array_append(s, F.element_at(s, -1) + x)))
    block = lambda i: F.floor(i / _BLOCK).cast("int")
    inside = lambda i: F.aggregate(F.slice(values, block(i) * _BLOCK + 1, i % _BLOCK), zero, add)
    return let(grown, lambda g: F.transform(values, lambda x, i: F.get(g, block(i)) + inside(i)))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, mask (array of start and length) from rows of conv_id, turn, role, text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text")))).alias("turns"))

    def pieces(t: Column) -> Column:
        role = lambda i: F.get(t, i)["role"]
        opens = lambda i: (i == 0) | (role(i) != role(i - 1))
        closes = lambda i: (i == F.size(t) - 1) | (role(i) != role(i + 1))
        return F.transform(t, lambda x, i: F.struct(
            F.when(opens(i), F.concat(F.lit("<turn "), escape(x["role"], role=True), F.lit(">"))).otherwise(SEPARATOR).alias("before"),
            escape(x["text"]).alias("body"),
            F.when(closes(i), END).otherwise("").alias("after"),
            (x["role"] == "assistant").alias("loss")))

    def laid(p: Column, starts: Column) -> Column:
        spans = F.transform(p, lambda x, i: F.struct((F.get(starts, i) + F.length(x["before"])).alias("start"), F.length(x["body"]).cast("long").alias("length"), x["loss"].alias("loss")))
        mask = F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["start"], s["length"]))
        formatted = F.array_join(F.transform(p, lambda x: F.concat(x["before"], x["body"], x["after"])), "")
        return F.struct(formatted.alias("formatted"), mask.alias("mask"))

    sizes = lambda p: F.transform(p, lambda x: F.length(x["before"]).cast("long") + F.length(x["body"]) + F.length(x["after"]))
    out = let(F.col("turns"), lambda t: let(pieces(t), lambda p: let(let(sizes(p), running_sum), lambda s: laid(p, s))))
    return turns.select("conv_id", out.alias("o")).select("conv_id", "o.formatted", "o.mask")


def parse(formatted: DataFrame) -> DataFrame:
    """Adds turns (role and text, in order) and the texts under the mask, both from the formatted string."""
    runs = F.filter(F.split("formatted", END), lambda r: r != "")
    head = lambda r: F.substring_index(r, ">", 1)
    body = lambda r: r.substr(F.length(head(r)) + 2, F.length(r))
    named = lambda r: unescape(head(r).substr(F.lit(len("<turn ") + 1), F.length(r)))
    turns = F.flatten(F.transform(runs, lambda r: F.transform(F.split(body(r), SEPARATOR), lambda t: F.struct(named(r).alias("role"), unescape(t).alias("text")))))
    under = F.transform("mask", lambda m: unescape(F.col("formatted").substr((m["start"] + 1).cast("int"), m["length"].cast("int"))))
    return formatted.withColumns({"turns": turns, "loss_texts": under})


def digests(parsed: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return parsed.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def chat_table(rows: DataFrame) -> DataFrame:
    """Formats, writes, reads back and digests."""
    return digests(parse(stored(format_conversations(rows), "chat")))

"""Labelled training rows: which rows may be learned from, and a bounded, reproducible sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.storage import stored


def held_out(id_col: str = "doc_id") -> Column:
    """True where the CRC-32 of the id's text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


#: Bytes of text in a sample of labelled rows.
MAX_BYTES = 1 << 26


def sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, text, label) of labelled documents outside the held-out fold, by a hash of the id.

    At most ``max_rows`` rows, and of these the first whose texts have ``max_bytes`` together; both are bounds on what a
    model is fitted from.  Labels other than 0 and 1 are left out; of several labels of one id the largest counts, of
    several texts the first.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(*order).limit(max_rows)
    chosen = stored(chosen, "labelled")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id")  # max_rows rows of two numbers
    found = stored(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "labelled-texts")
    if (found.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= max_bytes:
        return found
    so_far = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # max_rows rows of two numbers
    some = found.select("doc_id", F.octet_length("text").alias("size")).withColumn("size", so_far).where(F.col("size") <= max_bytes)
    return found.join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi")

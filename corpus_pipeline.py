"""From raw documents to packed training sequences.

Stages, in order: documents that score as toxic go; of each group of near duplicates the one of smallest id stays;
personal data is replaced by placeholders; the rest is put in an order that mixes sources to target weights; and that
order is packed into windows of tokens.  All stages but the last return the columns of ``documents``.

Defined results: a null text is an empty one; empty and null texts score as not toxic, are near no other text and pack
as their end id alone.  Rows of null id are documents of their own, but for whole copies of others, which go; of
repeated rows one stays.  Ties in the order go to the smaller id.  Extra columns pass through every stage but the last
unchanged, whatever their names.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import mixing, near_duplicates, packing, pii, toxicity
from quern.llm.storage import stored, written_place

#: Similarity of shingle sets, in hundredths, from which documents are near duplicates (op7 by itself keeps its own 85).
NEAR = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples don't mark as toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.kept(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (five-word shingle sets of similarity 0.8 or more), and one row of whole copies of one id or none."""
    found = stored(near_duplicates.near_duplicates(docs, threshold=NEAR), "found")
    return near_duplicates.without_copies(near_duplicates.survivors(docs, found), docs, found)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in their texts."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixed order: part p holds the p-th stretch of the schedule."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents' tokens in windows; one row a piece, numbered in the order in which ``docs`` was written."""
    return packing.pack(docs, place=written_place(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", redact),
    ("mixing", mix),
    ("packing", pack),
]

#: Not expressible in SQL: the stages learn models, compare sketches and run a tokenizer.  Tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

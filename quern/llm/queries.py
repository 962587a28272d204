"""The ten operators over the driver's tables, with production parameters and whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.llm import chat, media, mixing, nbsvm, near_duplicates, packing, pii, token_store, toxicity, vantage

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


#: The contract's own conversation, whose texts hold a backslash and a closing mark.
_HOSTILE = r"""
SELECT -7L AS conv_id, t AS turn, r AS role, r'\### Assistant: </turn> ok' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)
"""


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_table(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return nbsvm.score(docs, nbsvm.fit(docs, table(spark, sf_dir, "labels")))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_table(rows.unionByName(spark.sql(_HOSTILE)))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.positions(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(table(spark, sf_dir, "documents"))


def op9_vantage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_pii, op2_media, op3_quality, op4_chat, op5_mixing, op6_packing, op7_near_duplicates, op8_token_store, op9_vantage, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op4_chat": OP4_SQL}


#: The format's length: each turn's text with & and < escaped, a header and an end per run of one role, separators inside.
OP4_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), runs AS (
  SELECT *, lag(role) OVER w IS DISTINCT FROM role OR row_number() OVER w = 1 AS opens,
    length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) AS body,
    length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS name
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(body + CASE WHEN opens THEN name + 7 + 8 ELSE 6 END) AS BIGINT) AS formatted_chars
FROM runs GROUP BY conv_id
"""

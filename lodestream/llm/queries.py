"""Queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .langid import learn, predict
from .mpegaudio import read_media, write_media
from .packing import pack_documents
from .pieces import count_tokens, decode, encode
from .private import sanitiser
from .simhash import near_duplicates
from .tokenfile import read_token_files, write_token_files
from .toolcalls import linked_chats
from .topk import integer_vectors, top_k


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)


def op4_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_media(write_media(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op5_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sanitiser(docs).spans(docs)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of whole texts by the file's scores as a unigram table, decoded again.

    The installed file was built for merges, so these ids aren't those that the library gives with it.
    """
    path = public_tokenizers.path("piece_bpe_32k.model")
    decoded = F.sha2(F.col("text").cast("binary"), 256)
    rows = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return rows.select("doc_id", "n_pieces", "ids_crc32", decoded.alias("decoded_sha256"), (decoded == F.col("text_sha256")).alias("exact"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0, k=5)


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(files)


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_chats(table(spark, sf_dir, "conversations"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the pieces that op6_sentencepiece finds; like its ids they aren't the library's."""
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_language": op2_language,
        "op3_packing": op3_packing,
        "op4_mpeg_audio": op4_mpeg_audio,
        "op5_private": op5_private,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_topk": op7_topk,
        "op8_token_output": op8_token_output,
        "op9_tool_calls": op9_tool_calls,
        "op10_token_counts": op10_token_counts,
    }


# SQL can't express op1 to op6, op8 and op10 (XXH64, a trained network, tokenizers, media); tests hold them against plain versions.
_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS terms
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.terms, c.terms), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))), 0) AS BIGINT) AS score
  FROM (SELECT vec_id, min(terms) AS terms FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id) q JOIN v c ON c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

_TOOL_CALLS = """
WITH m AS (SELECT conv_id, turn, lower(trim(role)) AS role, text FROM conversations),
u AS (
  SELECT *, 'call:' || conv_id || ':' || turn AS call_id, min(turn) OVER (PARTITION BY conv_id) AS first
  FROM m WHERE role = 'user' AND turn IS NOT NULL AND conv_id IS NOT NULL
), a AS (
  SELECT *, 'call:' || conv_id || ':' || (turn - 1) AS call_id
  FROM m WHERE role = 'assistant' AND turn IS NOT NULL AND conv_id IS NOT NULL
), answer AS (SELECT conv_id, call_id, min({'t': turn, 'c': text}) AS b FROM a GROUP BY ALL),
known AS (SELECT DISTINCT conv_id, call_id, CAST(first < turn AS INTEGER) AS level FROM u)
SELECT u.conv_id, u.turn, 'call' AS kind, u.call_id, b IS NOT NULL AS linked, CAST(first < turn AS INTEGER) AS level,
  coalesce(length(text) > 0, false) AS valid,
  '{"arguments":{' || CASE WHEN first < turn THEN '"context":"call:' || u.conv_id || ':' || first || '",' ELSE '' END
    || coalesce('"prompt":' || CAST(to_json(text) AS VARCHAR) || ',', '') || '"turn":' || turn || '},"id":"' || u.call_id
    || '","name":"respond","result":' || CASE WHEN b IS NULL THEN 'null' ELSE '{"content":'
    || coalesce(CAST(to_json(b.c) AS VARCHAR), 'null') || ',"turn":' || b.t || '}' END || ',"role":"assistant"}' AS message
FROM u LEFT JOIN answer USING (conv_id, call_id)
UNION ALL
SELECT a.conv_id, a.turn, 'result', a.call_id, k.level IS NOT NULL, k.level + 1, NULL,
  '{"content":' || coalesce(CAST(to_json(a.text) AS VARCHAR), 'null') || ',"role":"tool","tool_call_id":"' || a.call_id || '"}'
FROM a LEFT JOIN known k USING (conv_id, call_id)
UNION ALL
SELECT conv_id, turn, 'message', NULL, false, NULL, NULL,
  '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}'
FROM m WHERE NOT coalesce(role IN ('user', 'assistant') AND turn IS NOT NULL AND conv_id IS NOT NULL, false)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_topk": _TOP_K, "op9_tool_calls": _TOOL_CALLS}

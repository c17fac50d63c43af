"""Queries over catalogs: joins of targets, checks, histograms and picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import media_id, sha256, stable_bucket
from ..functions.text import messages
from ..operators.catalog import allowed_status, histogram, in_splits, nested_index, paired_sources, same_targets, stable_pick, stale_rows
from ..operators.validation import duplicates, faults, missing, overlaps
from ..sources.tables import require_columns, table
from .bridges import EPOCH, SEED
from .registry import bucket_sql, query


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their splits: lang, and what labels say."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels")
    joined = docs.join(labels, "doc_id", "left")
    marks = [F.col("lang"), F.when(F.col("quality") == 1, F.lit("good")), F.when(F.col("toxic") == 1, F.lit("toxic"))]
    return joined.select("doc_id", F.filter(F.array(*marks), lambda x: x.isNotNull()).alias("splits"))


_SPLITS_SQL = """
SELECT d.doc_id, list_filter([lang, CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS splits
FROM documents d LEFT JOIN labels l USING (doc_id)
"""


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = require_columns(table(spark, sf_dir, "documents"), ["doc_id", "source", "n_chars"])
    turns = require_columns(table(spark, sf_dir, "conversations"), ["conv_id", "turn", "role", "text"]).withColumnRenamed("conv_id", "doc_id")
    return nested_index(docs, turns, "doc_id", "turn", F.col("role"), "assistant", "user", "text")


@query(
    "catalog_nested_index",
    """
WITH t AS (
  SELECT conv_id AS doc_id,
    list({'turn': turn, 'text': text} ORDER BY turn) FILTER (role = 'assistant') AS captions,
    arg_min(text, turn) FILTER (role = 'user') AS transcript,
    count(*) FILTER (role = 'user') AS n_transcripts
  FROM conversations GROUP BY conv_id
)
SELECT doc_id, source, CAST(coalesce(len(captions), 0) AS INTEGER) AS n_captions, captions[1].turn AS first_turn, captions[-1].turn AS last_turn,
  sha256(array_to_string(list_transform(captions, lambda x: x.text), '|')) AS captions_sha256, transcript, coalesce(n_transcripts, 0) AS n_transcripts
FROM documents LEFT JOIN t USING (doc_id)
""",
)
def catalog_nested_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _index(spark, sf_dir)
    text = F.when(F.size("captions") > 0, sha256(F.array_join(F.transform("captions", lambda x: x["text"]), "|")))
    first, last = F.try_element_at("captions", F.lit(1)), F.try_element_at("captions", F.lit(-1))
    return found.select("doc_id", "source", F.size("captions").alias("n_captions"), first["turn"].alias("first_turn"), last["turn"].alias("last_turn"), text.alias("captions_sha256"), F.col("transcript.text").alias("transcript"), "n_transcripts")


@query(
    "reference_count_histogram",
    """
SELECT n_captions, count(*) AS n_rows FROM (
  SELECT CAST(count(c.conv_id) FILTER (role = 'assistant') AS INTEGER) AS n_captions
  FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id GROUP BY d.doc_id)
GROUP BY n_captions
""",
)
def reference_count_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(_index(spark, sf_dir), F.size("captions"), "n_captions")


_PAIRS = [("en", "good"), ("en", "toxic"), ("good", "toxic"), ("fr", "good")]


@query(
    "split_overlap_report",
    "SELECT " + ", ".join(f"count(*) FILTER (list_contains(splits, '{a}') AND list_contains(splits, '{b}')) AS {a}_{b}" for a, b in _PAIRS) + f" FROM ({_SPLITS_SQL})",
)
def split_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(_splits(spark, sf_dir), "splits", _PAIRS)


@query("split_selection", f"SELECT doc_id, CAST(len(splits) AS INTEGER) AS n_splits FROM ({_SPLITS_SQL}) WHERE list_has_any(splits, ['good', 'de'])")
def split_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits(spark, sf_dir).filter(in_splits("splits", ["good", "de"])).select("doc_id", F.size("splits").alias("n_splits"))


_STATUS_SQL = "CASE WHEN quality = 1 AND toxic = 0 THEN 'approved' WHEN toxic = 1 THEN 'rejected' ELSE '' END"


@query(
    "review_status_histogram",
    f"""
WITH s AS (SELECT {_STATUS_SQL} AS status FROM labels)
SELECT status, count(*) AS n_rows, CASE WHEN status IN ('approved', '') THEN count(*) ELSE 0 END AS n_kept FROM s GROUP BY status
""",
)
def review_status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "approved").when(F.col("toxic") == 1, "rejected").otherwise("")
    rows = table(spark, sf_dir, "labels").select(status.alias("status"))
    return rows.groupBy("status").agg(F.count("*").alias("n_rows"), F.count_if(allowed_status("status", ["approved", ""])).alias("n_kept"))


@query(
    "uniqueness_violations",
    """
SELECT 'documents.doc_id' AS key, count(*) AS n_keys FROM (SELECT doc_id FROM documents GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'documents.text', count(*) FROM (SELECT text FROM documents GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'conversations.conv_id,turn', count(*) FROM (SELECT conv_id, turn FROM conversations GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'conversations.user', count(*) FROM (SELECT conv_id FROM conversations WHERE role = 'user' GROUP BY ALL HAVING count(*) > 1)
""",
)
def uniqueness_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    found = {
        "documents.doc_id": duplicates(docs, "doc_id"),
        "documents.text": duplicates(docs.select(sha256(F.col("text")).alias("h")), "h"),
        "conversations.conv_id,turn": duplicates(turns, "conv_id", "turn"),
        "conversations.user": duplicates(turns.filter("role = 'user'"), "conv_id"),
    }
    parts = [df.agg(F.lit(k).alias("key"), F.count("*").alias("n_keys")) for k, df in found.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(
    "stable_reference_pick",
    f"""
WITH t AS (SELECT conv_id, list(text ORDER BY turn) AS texts, list(turn ORDER BY turn) AS turns FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, turns[{bucket_sql(SEED, EPOCH, "conv_id", "len(turns)")} + 1] AS turn, texts[{bucket_sql(SEED, EPOCH, "conv_id", "len(turns)")} + 1] AS text FROM t
""",
)
def stable_reference_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    nested = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("captions"))
    return nested.select("conv_id", stable_pick(nested, "captions", SEED, EPOCH, "conv_id").alias("p")).select("conv_id", "p.turn", "p.text")


@query(
    "caption_transcript_join",
    """
WITH u AS (SELECT conv_id, min(turn) AS turn, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT a.conv_id, a.turn, u.turn AS transcript_turn, sha256('Caption: ' || a.text || chr(10) || 'Transcript: ' || u.text) AS combined_sha256
FROM conversations a JOIN u USING (conv_id) WHERE a.role = 'assistant'
""",
)
def caption_transcript_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers beside the first question of their conversation, which is its one transcript."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", "text")
    first = turns.filter("role = 'user'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("u")).select("conv_id", F.lit("user").alias("role"), "u.turn", "u.text")
    answers = turns.filter("role = 'assistant'").join(first, "conv_id", "left_semi")
    pairs = paired_sources(answers.unionByName(first), "conv_id", "role", "assistant", "user")
    combined = F.format_string("Caption: %s\nTranscript: %s", "a.text", "b.text")
    return pairs.select("conv_id", "a.turn", F.col("b.turn").alias("transcript_turn"), sha256(combined).alias("combined_sha256"))


@query("missing_target_antijoin", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_target_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    "allowed_stream_rows",
    "SELECT source, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source",
)
def allowed_stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(allowed, "doc_id", "left_semi")
    return docs.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("n_chars").cast("long").alias("n_chars"))


@query(
    "payload_hash_contract",
    """
SELECT page_id, octet_length(encode(html)) AS n_bytes, sha256(html) AS digest, sha256(html) = sha256(trim(html)) AS unpadded FROM pages
""",
)
def payload_hash_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.octet_length(html).cast("long").alias("n_bytes"), sha256(html).alias("digest"), (sha256(html) == sha256(F.trim(html))).alias("unpadded"))


@query(
    "stale_sidecar_rows",
    """
WITH a AS (SELECT doc_id, sha256(text) AS digest FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE sha256(text || CASE WHEN doc_id % 7 = 0 THEN ' ' ELSE '' END) END AS sidecar_digest FROM documents)
SELECT doc_id, digest, sidecar_digest FROM a JOIN b USING (doc_id) WHERE digest IS DISTINCT FROM sidecar_digest
""",
)
def stale_sidecar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose text has changed since the sidecar was written, or of which it has no digest."""
    docs, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    then = F.when(n % 9 != 0, sha256(F.concat("text", F.when(n % 7 == 0, " ").otherwise(""))))
    return stale_rows(docs.select("doc_id", sha256(F.col("text")).alias("digest")), docs.select("doc_id", then.alias("digest")), "doc_id", "digest")


@query(
    "contract_faults",
    """
SELECT unnest(['id', 'length', 'lang', 'not_blank']) AS rule, unnest([
  count(*) FILTER (NOT coalesce(doc_id >= 0, false)), count(*) FILTER (NOT coalesce(n_chars = length(text), false)),
  count(*) FILTER (NOT coalesce(lang IN ('en', 'fr', 'de'), false)), count(*) FILTER (NOT coalesce(length(trim(text)) > 40, false))]) AS n_rows
FROM documents
""",
)
def contract_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return faults(docs, {"id": F.col("doc_id") >= 0, "length": F.col("n_chars") == F.length("text"), "lang": F.col("lang").isin("en", "fr", "de"), "not_blank": F.length(F.trim("text")) > 40})


@query(
    "target_set_difference",
    """
WITH a AS (SELECT DISTINCT conv_id, role, turn FROM conversations WHERE turn > 0), b AS (SELECT DISTINCT conv_id, role, turn FROM conversations WHERE role <> 'user')
SELECT *, 'left' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
""",
)
def target_set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return same_targets(turns.filter("turn > 0"), turns.filter("role <> 'user'"), ["conv_id", "role", "turn"])


@query(
    "media_identity",
    """
SELECT doc_id, sha256(CAST(doc_id AS VARCHAR) || chr(0) || sha256(text) || chr(0) || CASE WHEN n_chars * 160 > 480000 THEN CAST((n_chars * 160 - 480000) // 2 AS VARCHAR) ELSE 'None' END
  || chr(0) || CAST(n_chars * 160 AS VARCHAR) || chr(0) || 'front' || chr(0) || 'projector') AS media_id FROM documents
""",
)
def media_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    n = F.col("n_chars").cast("long") * 160
    crop = F.when(n > 480000, F.call_function("div", n - 480000, F.lit(2).cast("long")))
    return docs.select("doc_id", media_id(F.col("doc_id").cast("string"), sha256(F.col("text")), crop, n, F.lit("front"), F.lit("projector")).alias("media_id"))


@query(
    "chat_messages",
    """
SELECT conv_id, turn, sha256('user:' || '<audio>' || '|assistant:' || text) AS chat_sha256 FROM conversations WHERE role = 'assistant' AND trim(text) <> ''
""",
)
def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'assistant' and trim(text) <> ''")
    chat = messages(("user", F.lit("<audio>")), ("assistant", F.col("text")))
    joined = F.array_join(F.transform(chat, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return turns.select("conv_id", "turn", sha256(joined).alias("chat_sha256"))


@query(
    "content_dedupe",
    "SELECT sha256(text) AS digest, min(doc_id) AS kept, count(*) AS n_rows, octet_length(encode(any_value(text))) AS n_bytes FROM documents GROUP BY 1",
)
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", sha256(F.col("text")).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("kept"), F.count("*").alias("n_rows"), F.max("n_bytes").alias("n_bytes"))


@query(
    "distinct_shards",
    "SELECT source AS shard, count(*) AS n_rows, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM documents GROUP BY source",
)
def distinct_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("shard")).agg(F.count("*").alias("n_rows"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


@query("bucket_histogram", f"SELECT {bucket_sql(SEED, EPOCH, 'o_orderkey', '16')} AS bucket, count(*) AS n_rows FROM orders GROUP BY 1")
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return histogram(orders, stable_bucket(SEED, EPOCH, F.col("o_orderkey"), 16), "bucket")

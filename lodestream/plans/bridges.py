"""How the driver's tables stand in for catalogs: documents are audio rows (a character is 160 samples, source the shard, lang the
split), conversations their typed targets, events an append log, benchmark the items of a benchmark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.audio import chunked_encoder_frames, projected_tokens
from ..functions.hashing import stable_bucket
from ..functions.text import words
from ..sources.tables import table

SEED, EPOCH, WORKERS, STACK = 1337, 0, 4, 4


def samples() -> Column:
    return F.col("n_chars").cast("long") * 160


def tokens() -> Column:
    """Length of a document as an example: its words, marks and audio tokens."""
    return words(F.col("text")) + 2 + projected_tokens(chunked_encoder_frames(samples()), STACK)


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, worker and length of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", stable_bucket(SEED, EPOCH, F.col("doc_id"), WORKERS).alias("worker"), tokens().alias("length"))


# The same in SQL.
FRAMES_SQL = "((n_chars * 160) // 480000) * 1500 + (((n_chars * 160) % 480000 + 159) // 160 + 1) // 2"
TOKENS_SQL = f"len(regexp_extract_all(text, '\\S+')) + 2 + (({FRAMES_SQL}) + 3) // 4"

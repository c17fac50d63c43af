"""The corpus pipeline: language, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestream.llm.common import store, table
from lodestream.llm.langid import keep_known, learn
from lodestream.llm.packing import pack_documents
from lodestream.llm.private import sanitiser
from lodestream.llm.simhash import keep_one

def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language at least as probable as noise; the network learns from these documents.

    Null and empty texts, and texts without a letter, go; rows that repeat stay; an empty table gives no rows.
    """
    return keep_known(docs, learn(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the least doc_id, those without one last; of repeated rows one.

    Null, empty and blank texts are near-duplicates of each other; an empty table gives no rows.
    """
    return keep_one(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and the terms that disclose it taken out of their texts.

    Every row stays; a null text stays null and an empty one empty; an empty table gives no rows.
    """
    return sanitiser(docs).sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences; a null or empty text is its end id alone; an empty table gives no rows."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: SQL can express none of the stages; the tests hold run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs

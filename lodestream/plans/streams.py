"""Queries that run as streams: their result is the table that they have committed."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import perplexity
from ..operators import packing
from ..operators.ordering import with_group_position
from ..sources.tables import shared_dir, table
from ..streaming.commits import commit_once
from ..streaming.drain import drained
from ..streaming.epochs import evaluated, updates
from ..streaming.planner import end_marks, planned
from .bridges import lengths
from .packs import SMALL_CAPACITY, WINDOW
from .registry import SQL, query


@query("stream_commit_once", "SELECT event_id, event_type, user_id FROM events WHERE event_type <> 'error'")
def stream_commit_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read twice as a stream, each committed once in its epoch."""
    source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    rows = source.filter(F.col("event_type") != "error").select("event_id", "event_type", "user_id")
    return commit_once(rows, "event_id", epoch=0, times=2).drop("epoch")


def _after_each(column: str) -> str:
    return f"""
WITH p AS (SELECT * FROM ({SQL["worker_pack_totals"]}))
SELECT {column} FROM p
"""


@query("stream_pack_stats", _after_each("n_packs, n_items, n_oversized, tokens, utilisation, lower_bound"))
def stream_pack_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers' streams packed as they arrive, in three goes and an end mark: the same packs as in one batch."""
    base = f"{shared_dir(spark)}/lodestream-{spark.sparkContext.applicationId}/planner-{uuid.uuid4().hex}"
    rows = with_group_position(lengths(spark, sf_dir).select("worker", "doc_id", "length"), "worker", [F.col("doc_id")], "ordinal").select("worker", "ordinal", "length")
    goes = [rows.filter("ordinal < 100"), rows.filter("ordinal >= 100 and ordinal < 1000"), rows.filter("ordinal >= 1000"), end_marks(rows)]
    for part in goes:
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("worker long, ordinal long, length long").parquet(f"{base}/in")
        writer = planned(stream, SMALL_CAPACITY, WINDOW).writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
        writer.start(f"{base}/out").awaitTermination()
    packs = spark.read.schema("worker long, window long, pack int, ordinal long, length long, skipped long").parquet(f"{base}/out")
    each = packing.pack_stats(packs, ["worker"], "worker", "length", SMALL_CAPACITY, rows)
    total = packing.merge_stats(each, [], F.lit(SMALL_CAPACITY))
    return total.select("n_packs", "n_items", "n_oversized", "tokens", F.round("utilisation", 9).alias("utilisation"), "lower_bound")


@query(
    "epoch_updates",
    """
WITH g AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 7 AS grp FROM events), u AS (SELECT grp, count(*) AS n_items FROM g GROUP BY grp), n AS (SELECT count(*) AS n FROM u)
SELECT epoch * n + grp AS update, CAST(epoch AS INTEGER) AS epoch, n_items, n_items AS weight FROM u, n, (SELECT unnest(range(3)) AS epoch) WHERE epoch * n + grp < 400
""",
)
def epoch_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of groups of seven events, epoch after epoch until there are 400; an epoch's last group may be smaller."""
    schema = table(spark, sf_dir, "events").schema

    def stream() -> DataFrame:
        return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").select("event_id", F.lit(1).cast("long").alias("w"))

    path = f"{shared_dir(spark)}/lodestream-{spark.sparkContext.applicationId}/epochs-{uuid.uuid4().hex}"
    return updates(stream, "event_id", "w", 1e18, 7, 400, path)


@query("drained_stream", "SELECT doc_id, n_chars FROM documents")
def drained_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in files, a file a batch, streamed until none is left."""
    base = f"{shared_dir(spark)}/lodestream-{spark.sparkContext.applicationId}/drain-{uuid.uuid4().hex}"
    table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars")).repartition(4, "doc_id").write.parquet(f"{base}/in")
    stream = spark.readStream.schema(table(spark, sf_dir, "documents").select("doc_id", "n_chars").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    return drained(stream, f"{base}/out")


@query(
    "evaluation_points",
    "WITH u AS (SELECT event_id // 10 AS update, count(*) AS n_items, round(avg(value), 6) AS nll FROM events GROUP BY 1) SELECT update, n_items, round(exp(least(nll / 10, 20)), 4) AS perplexity FROM u WHERE (update + 1) % 5 = 0",
)
def evaluation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation after every fifth update: the feature is the interval."""
    done = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 10).cast("long").alias("update")).agg(F.count("*").alias("n_items"), F.round(F.avg("value"), 6).alias("nll"))
    return evaluated(done, 5, lambda rows: rows.select("update", "n_items", F.round(perplexity(F.col("nll") / 10), 4).alias("perplexity")))

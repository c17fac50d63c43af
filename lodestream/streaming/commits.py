"""Appending each key once in an epoch, whatever is read or run again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import ContractError, exists, shared_dir

_KEPT = "spark.sql.streaming.numRecentProgressUpdates"


def commit_batch(batch: DataFrame, number: int, epoch: int, path: str) -> None:
    """Writes a batch in a folder of its own, so that one that runs again takes the place of what it wrote before."""
    batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}/batch={number}")


def _dropped(run: StreamingQuery) -> int:
    """Rows that a finished run's deduplication has dropped."""
    return sum(int(x.customMetrics.get("numDroppedDuplicateRows", 0)) for p in run.recentProgress for x in p.stateOperators)


def commit_once(stream: DataFrame, key: str, epoch: int, times: int = 1, path: str | None = None, duplicates: str = "error") -> DataFrame:
    """Runs a stream until it has read what there is, times over under one checkpoint, and returns what is committed.

    The checkpoint says what has been read and keeps the keys of the epoch as state, so a batch costs what it holds, whatever was
    committed before. A key that comes again is not committed again; it is an error unless duplicates is "drop". Another epoch has a
    checkpoint, and so keys, of its own.
    """
    if duplicates not in ("error", "drop"):
        raise ValueError(f"unknown way with duplicates: {duplicates}")
    spark = stream.sparkSession
    base = path or f"{shared_dir(spark)}/commits-{uuid.uuid4().hex}"
    names, kept = stream.columns, spark.conf.get(_KEPT)
    spark.conf.set(_KEPT, str(1 << 20))
    try:
        for _ in range(times):
            writer = stream.dropDuplicates([key]).writeStream.option("checkpointLocation", f"{base}/checkpoint-{epoch}").trigger(availableNow=True)
            run = writer.foreachBatch(lambda batch, number: commit_batch(batch, number, epoch, f"{base}/rows")).start()
            run.awaitTermination()
            if duplicates == "error" and (again := _dropped(run)):
                raise ContractError(f"{again} rows have a {key} that is committed already")
    finally:
        spark.conf.set(_KEPT, kept)
    schema = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes)
    if not exists(spark, f"{base}/rows/epoch={epoch}"):
        return spark.createDataFrame([], f"{schema}, epoch int")
    return spark.read.schema(f"{schema}, epoch int, batch long").parquet(f"{base}/rows").filter(f"epoch = {epoch}").select(*names, "epoch")

"""Running a stream with bounded batches until all that is there is written, and stopping it whatever happens."""

from __future__ import annotations

from pyspark.sql import DataFrame


def drained(stream: DataFrame, path: str) -> DataFrame:
    """What a stream writes to a table before it is stopped: all that its source holds when this is called.

    How much a batch takes is the source's option (maxFilesPerTrigger), so no more than that is in flight.
    """
    run = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").start(f"{path}/rows")
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")

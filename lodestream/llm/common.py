"""Shared plumbing: tables, shared storage and bounded blocks of text."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as one block.
BLOCK_BYTES = 1 << 20
#: Keys that join_hot() broadcasts at most, and the rows from which a key may be one of them.
HOT_KEYS, HOT_ROWS = 100_000, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="lodestream-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back, which cuts its lineage.

    Spark's output committer keeps one result per task, whatever retries or lost executors there were. The application's tables are
    deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/lodestream-{spark.sparkContext.applicationId}"
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(base)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before those that df has a column of, whatever its case."""
    taken, out = {x.lower() for x in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def join_hot(rows: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """The inner join of rows with own (key, each once, and n: how many rows have it) by key, without n.

    The HOT_KEYS keys with most rows are broadcast, so that none of them goes to one task; any other has at most one HOT_KEYS-th
    of all rows. Both sides are read twice, so they should be tables.
    """
    hot = F.broadcast(own.filter(F.col("n") >= HOT_ROWS).orderBy(F.desc("n"), key).limit(HOT_KEYS).drop("n"))
    rest = rows.join(hot.select(key), key, "left_anti").join(own.drop("n"), key)
    return rows.join(hot, key).unionByName(rest)


def text_blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about limit bytes: first row, UTF-8 bytes, offsets of the rows in them. Null is empty.

    A row longer than limit is a block of its own.
    """
    column = pc.fill_null(batch.column(batch.schema.get_field_index(column)), "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end

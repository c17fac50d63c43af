"""Writers of predictions and of content that is kept once."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import perplexity
from ..operators.validation import require_unique
from .tables import ContractError, exists

PART_ROWS = 256


def write_predictions(rows: DataFrame, path: str, key: str, part_rows: int = PART_ROWS) -> None:
    """Appends predictions as Parquet parts of at most so many rows, and the same rows as JSON lines; a key written before is an error."""
    if exists(rows.sparkSession, f"{path}/parquet"):
        done = rows.sparkSession.read.parquet(f"{path}/parquet").select(key)
        if again := done.join(rows.select(key), key, "left_semi").head(1):
            raise ContractError(f"{key} {again[0][0]} has a prediction")
    require_unique(rows, key)
    rows.write.mode("append").option("compression", "zstd").option("maxRecordsPerFile", part_rows).parquet(f"{path}/parquet")
    rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(f"{path}/json")


def completed_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that have a prediction; one that has two is an error."""
    require_unique(rows, key)
    return rows.select(key)


def keep_content(rows: DataFrame, path: str, content: str) -> DataFrame:
    """Adds contents (binary) that a store lacks, once each, under their digest; rows with digest in place of content.

    The store is a table by the digest's first two digits, so a lookup reads one part of it.
    """
    spark = rows.sparkSession
    marked = rows.withColumn("digest", F.sha2(content, 256))
    fresh = marked.filter(F.col(content).isNotNull()).select("digest", F.col(content).alias("content"), F.substring("digest", 1, 2).alias("head"))
    if exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select("digest", "head"), ["digest", "head"], "left_anti")
    fresh.dropDuplicates(["digest"]).repartition("head").write.mode("append").partitionBy("head").parquet(path)
    return marked.drop(content)


def append_metrics(rows: DataFrame, path: str) -> None:
    """Appends rows of measurements as JSON lines with sorted names, and the perplexity of their nll."""
    whole = rows.withColumn("perplexity", perplexity(F.col("nll")))
    whole.select(F.to_json(F.struct(*sorted(whole.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def _base64(value: Column) -> Column:
    """Base64 in one line: Spark's own breaks it after 76 characters, which a URI may not have."""
    return F.translate(F.base64(value), "\r\n", "")


def wav_uri(rows: DataFrame, channels: str, rate: int) -> DataFrame:
    """rows with a column uri: their channels (arrays of samples from -1 to 1, of equal length) as one, in 16-bit PCM, as the bytes themselves."""
    n, many = F.size(F.col(channels)[0]), F.size(channels)
    mean = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.aggregate(F.transform(channels, lambda c: c[k].cast("double")), F.lit(0.0), lambda a, x: a + x) / many)
    level = F.transform(mean, lambda x: F.bround(F.greatest(F.least(x, F.lit(1.0)), F.lit(-1.0)) * 32767).cast("int"))

    def little(value: Column, size: int) -> Column:
        digits = F.lpad(F.hex(F.pmod(value.cast("long"), F.lit(1 << 8 * size))), 2 * size, "0")
        return F.concat(*(F.substring(digits, 2 * (size - k) - 1, 2) for k in range(size)))

    body = F.array_join(F.transform(F.when(n > 0, level).otherwise(F.array().cast("array<int>")), lambda x: little(x, 2)), "")
    size = F.greatest(n, F.lit(0)) * 2
    head = F.concat(F.lit(b"RIFF".hex()), little(size + 36, 4), F.lit((b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data").hex()), little(size, 4))
    return rows.withColumn("uri", F.concat(F.lit("data:audio/wav;base64,"), _base64(F.unhex(F.concat(head, body)))))


def data_uri(content: DataFrame, column: str, kind: str = "audio/wav") -> DataFrame:
    """content with a column uri that holds the bytes themselves."""
    return content.withColumn("uri", F.concat(F.lit(f"data:{kind};base64,"), _base64(F.col(column))))

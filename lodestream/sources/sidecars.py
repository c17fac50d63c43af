"""Duration sidecars: checked, joined to catalogs, written; and payloads read by byte range once rows have been chosen."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.audio import RATE, sidecar_samples, streaminfo
from ..operators.validation import require_covered, require_unique
from .tables import ContractError, require_columns

# Where exact counts come from, and the columns that place a sample in a shard.
EXACT_SOURCES = ("flac_streaminfo", "libsndfile_header", "flac_empty")
REFERENCE = ("wds_shard", "wds_key", "flac_offset", "flac_size", "json_offset", "json_size")
BASE = ("audio_id", "num_samples", "duration_seconds", "flac_sha256")


def load(spark: SparkSession, path: str, exact: bool = False) -> DataFrame:
    """A sidecar whose audio_ids are unique; an exact one has exact sources and whole references."""
    df = spark.read.parquet(path)
    rows = require_columns(df, [*BASE, *((*REFERENCE, "num_samples_source") if exact else [c for c in REFERENCE if c in df.columns])])
    require_unique(rows, "audio_id")
    if exact:
        whole = F.lit(True)
        for c in REFERENCE:
            whole &= F.col(c).isNotNull()
        bad = rows.filter(~(F.coalesce(F.col("num_samples_source").isin(*EXACT_SOURCES), F.lit(False)) & whole)).head(1)
        if bad or rows.isEmpty():
            raise ContractError(f"the sidecar isn't exact: {bad[0].asDict() if bad else 'it is empty'}")
    return rows


def with_durations(catalog: DataFrame, sidecar: DataFrame, exact: bool = False) -> DataFrame:
    """catalog with the sidecar's columns; every row must have an entry of its digest, and of its place if exact."""
    require_covered(catalog, sidecar, "audio_id")
    renamed = sidecar.select("audio_id", *(F.col(c).alias(f"_{c}") for c in sidecar.columns if c != "audio_id"))
    joined = catalog.join(renamed, "audio_id")
    stale = ~F.col("flac_sha256").eqNullSafe(F.col("_flac_sha256"))
    if exact:
        for c in ("wds_shard", "wds_key", "flac_size"):
            stale |= ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    if bad := joined.filter(stale).select("audio_id").head(1):
        raise ContractError(f"the sidecar's entry of {bad[0][0]} is stale")
    new = [c for c in sidecar.columns if c not in catalog.columns]
    return joined.select(*catalog.columns, *(F.col(f"_{c}").alias(c) for c in new))


def estimated(catalog: DataFrame, durations: DataFrame, key: list[str]) -> DataFrame:
    """Sidecar rows from upstream durations (key, duration_seconds); a row without one is an error."""
    joined = catalog.join(durations.select(*key, "duration_seconds"), key, "left")
    if bad := joined.filter("duration_seconds is null").select("audio_id").head(1):
        raise ContractError(f"no duration of {bad[0][0]}")
    seconds = F.col("duration_seconds").cast("double")
    return joined.select("audio_id", sidecar_samples(seconds).alias("num_samples"), seconds.alias("duration_seconds"), "flac_sha256")


def from_samples(rows: DataFrame) -> DataFrame:
    """Sidecar rows of exact counts."""
    return rows.withColumn("duration_seconds", F.col("num_samples") / F.lit(float(RATE)))


def write(rows: DataFrame, path: str, n_expected: int | None = None) -> None:
    """Writes a sidecar in order of audio_id; Spark's committer makes all of it appear, or nothing."""
    if n_expected is not None and (n := rows.count()) != n_expected:
        raise ContractError(f"{n} rows for {n_expected} of the input")
    rows.repartitionByRange("audio_id").sortWithinPartitions("audio_id").write.option("compression", "zstd").parquet(path)


def usable(rows: DataFrame) -> DataFrame:
    """Rows with samples."""
    return rows.filter((F.col("num_samples") > 0) & (F.coalesce(F.col("num_samples_source"), F.lit("")) != "flac_empty"))


def read_payloads(planned: DataFrame, root: str) -> DataFrame:
    """planned rows (with REFERENCE columns) with flac and json, read from their shards after all planning is done.

    Rows are sorted by place, so a shard is read forwards; a short read is an error.
    """
    names = planned.columns
    at = {c: names.index(c) for c in REFERENCE}

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, file = None, None

        def read(offset: int, size: int) -> bytes:
            file.seek(offset)
            if len(data := file.read(size)) != size:
                raise OSError(f"shard {shard} ends within a member")
            return data

        for batch in batches:
            for x in range(0, batch.num_rows, 32):
                part = batch.slice(x, 32)
                flac, meta = [], []
                for where, a, n, b, m in zip(*(part.column(at[c]).to_pylist() for c in ("wds_shard", "flac_offset", "flac_size", "json_offset", "json_size")), strict=True):
                    if where != shard:
                        if file:
                            file.close()
                        shard, file = where, open(f"{root}/{where}", "rb")  # noqa: SIM115  kept over rows
                    flac.append(read(a, n))
                    meta.append(read(b, m).decode())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(flac, pa.binary()), pa.array(meta, pa.string())], names=[*names, "flac", "json"])
        if file:
            file.close()

    schema = planned.withColumns({"flac": F.lit(b""), "json": F.lit("")}).schema
    return planned.repartitionByRange("wds_shard", "flac_offset").sortWithinPartitions("wds_shard", "flac_offset").mapInArrow(fetch, schema)


def payload_faults(rows: DataFrame) -> DataFrame:
    """audio_id and fault of payloads (rows of read_payloads() with flac_sha256) that aren't what their catalog says."""
    info = streaminfo(F.col("flac"))
    named = F.get_json_object("json", "$.id").eqNullSafe(F.col("audio_id")) & F.col("wds_key").eqNullSafe(F.col("audio_id"))
    fault = (
        F.when(~named, "key")
        .when(F.length("flac") != F.col("flac_size"), "size")
        .when(~F.sha2("flac", 256).eqNullSafe(F.col("flac_sha256")), "digest")
        .when(info.isNull(), "format")
        .when(info["rate"] != RATE, "rate")
        .when(info["channels"] != 1, "channels")
    )
    return rows.select("audio_id", fault.alias("fault")).filter("fault is not null")

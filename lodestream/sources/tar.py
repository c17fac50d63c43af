"""Members of TAR shards as a data source: one partition a shard, headers read without payloads."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.audio import RATE, exact_source, streaminfo
from .tables import ContractError

HEADER_BYTES = 42
_SCHEMA = "shard string, key string, suffix string, offset long, size long, header binary"


class _Shard(InputPartition):
    def __init__(self, root: str, shard: str):
        self.root, self.shard = root, shard


class _TarReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.shards = options.get("root", ""), [x for x in options.get("shards", "").split("\n") if x]

    def partitions(self) -> list[InputPartition]:
        return [_Shard(self.root, x) for x in self.shards]

    def read(self, partition: _Shard) -> Iterator[tuple]:
        if not isinstance(partition, _Shard):
            return
        path = f"{partition.root}/{partition.shard}" if partition.root else partition.shard
        with tarfile.open(path, "r:") as archive:
            for member in archive:
                if member.isfile():
                    name = member.name.lstrip("./") if member.name.startswith("./") else member.name
                    key, _, suffix = name.rpartition(".")
                    file = archive.extractfile(member)
                    yield partition.shard, key, suffix, member.offset_data, member.size, file.read(HEADER_BYTES) if file else b""


class TarMembers(DataSource):
    """spark.read.format("tar_members").option("root", ...).option("shards", one a line)."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _TarReader(dict(self.options))


def members(spark: SparkSession, root: str, shards: list[str]) -> DataFrame:
    """shard, key, suffix, offset, size and header (first bytes) of every member. Executors need the shards under root."""
    spark.dataSource.register(TarMembers)
    return spark.read.format("tar_members").option("root", root).option("shards", "\n".join(shards)).load()


def sample_index(found: DataFrame) -> DataFrame:
    """A row for each sample: the places of its flac and json members and the header of the former."""

    def of(suffix: str, column: str) -> Column:
        return F.max(F.when(F.col("suffix") == suffix, F.col(column)))

    places = [of(s, c).alias(f"{s}_{c}") for s in ("flac", "json") for c in ("offset", "size")]
    return found.groupBy("shard", "key").agg(*places, of("flac", "header").alias("header"))


def exact_samples(catalog: DataFrame, index: DataFrame, probed: DataFrame | None = None) -> DataFrame:
    """catalog (audio_id, wds_shard, wds_key, flac_size) with byte ranges, num_samples and num_samples_source.

    Headers without a count take it from probed (audio_id, frames). A missing member, another size or another format is an error.
    """
    found = index.select(F.col("shard").alias("wds_shard"), F.col("key").alias("wds_key"), "flac_offset", F.col("flac_size").alias("tar_size"), "json_offset", "json_size", streaminfo(F.col("header")).alias("info"))
    joined = catalog.join(found, ["wds_shard", "wds_key"], "left")
    fault = (
        F.when(F.col("flac_offset").isNull() | F.col("json_offset").isNull(), "a member is missing")
        .when(F.col("tar_size") != F.col("flac_size"), "the size differs")
        .when(F.col("info").isNull(), "no FLAC header")
        .when((F.col("info.rate") != RATE) | (F.col("info.channels") != 1), "another format")
    )
    if bad := joined.select("audio_id", fault.alias("fault")).filter("fault is not null").head(1):
        raise ContractError(f"audio {bad[0]['audio_id']}: {bad[0]['fault']}")
    other = probed.select("audio_id", F.col("frames").cast("long").alias("frames")) if probed is not None else None
    joined = joined.join(other, "audio_id", "left") if other is not None else joined.withColumn("frames", F.lit(None).cast("long"))
    source = exact_source(F.col("info.samples"), F.col("frames"))
    samples = F.when(source == "flac_streaminfo", F.col("info.samples")).when(source == "libsndfile_header", F.col("frames")).otherwise(0)
    return joined.withColumns({"num_samples": samples, "num_samples_source": source}).drop("info", "tar_size", "frames")

"""Reading tables under a contract and storing results where all executors see them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class ContractError(ValueError):
    """A table doesn't hold what its contract says."""


class MissingColumns(ContractError):
    """A table lacks columns."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with these columns alone, so that no others are read."""
    if missing := [c for c in columns if c not in df.columns]:
        raise MissingColumns(f"columns missing: {', '.join(missing)}")
    return df.select(*columns)


def scan(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """These columns of a Parquet table."""
    return require_columns(spark.read.parquet(path), columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def first_existing(spark: SparkSession, candidates: list[str]) -> str:
    """The first of these paths that exists."""
    for path in candidates:
        if exists(spark, path):
            return path
    raise ContractError(f"none of these exist: {', '.join(candidates)}")


def catalog_path(spark: SparkSession, root: str, dataset: str, suffix: str) -> str:
    """Where a dataset's catalog lies, in one of three layouts."""
    return first_existing(spark, [f"{root}/{dataset}/{suffix}", f"{root}/catalog/{dataset}/{suffix}", f"{root}/{suffix}"])


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Only a local session without one gets a temporary folder."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ContractError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="lodestream-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _delete_at_end(spark: SparkSession, path: str) -> None:
    """Has the file system delete a folder when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def store(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: a cut in its lineage that outlives executors."""
    spark = df.sparkSession
    base = f"{shared_dir(spark)}/lodestream-{spark.sparkContext.applicationId}"
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _delete_at_end(spark, base)
    return spark.read.schema(df.schema).parquet(path)

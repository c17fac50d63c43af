"""Local mirrors of shards: marked once whole, and used only while they stay so."""

from __future__ import annotations

import json
import os
import tempfile
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import ContractError

# Fixed values of the marker.
MARKER = ".lodestream_complete.json"
FORMAT_VERSION = 1


def write_json(path: str, value: object) -> None:
    """Writes JSON with sorted keys so that a reader sees the old file or the new one."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".tmp")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as file:
            json.dump(value, file, indent=2, sort_keys=True)
            file.flush()
            os.fsync(file.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def require_same_manifest(path: str, manifest: dict) -> None:
    """Writes a manifest, or, where there is one, insists that it is the same."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            if json.load(file) != json.loads(json.dumps(manifest)):
                raise ContractError(f"{path} was written for other settings")
    else:
        write_json(path, manifest)


def listing(spark: SparkSession, root: str, pattern: str = "*.tar") -> DataFrame:
    """path (under root) and n_bytes of files; their contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split("://")[-1]
    return files.select(F.regexp_replace("path", f"^[a-z]*:/*{base.lstrip('/')}/", "").alias("path"), F.col("length").alias("n_bytes"))


def mark(spark: SparkSession, root: str, dataset: str, shards: list[str], pattern: str = "*.tar") -> dict:
    """Writes the marker of a mirror; a shard that is missing or empty is an error."""
    wanted = spark.createDataFrame([(x,) for x in shards], "path string")
    found = {r["path"]: r["n_bytes"] for r in listing(spark, root, pattern).join(wanted, "path").filter("n_bytes > 0").collect()}
    if missing := sorted(set(shards) - found.keys()):
        raise ContractError(f"{len(missing)} of {len(shards)} shards are missing or empty, the first is {missing[0]}")
    marker = {"format_version": FORMAT_VERSION, "dataset": dataset, "created_at": datetime.now(UTC).isoformat(), "shard_count": len(found), "total_bytes": sum(found.values()), "files": found}
    write_json(f"{root}/{MARKER}", marker)
    return marker


def complete(spark: SparkSession, root: str, dataset: str, shards: list[str], pattern: str = "*.tar") -> list[str] | None:
    """Paths of the shards, or None unless the mirror is marked for this dataset and every shard has the size noted."""
    try:
        with open(f"{root}/{MARKER}", encoding="utf-8") as file:
            marker = json.load(file)
    except (OSError, ValueError):
        return None
    files = marker.get("files")
    if marker.get("format_version") != FORMAT_VERSION or marker.get("dataset") != dataset or not isinstance(files, dict):
        return None
    if any(not isinstance(files.get(x), int) or files[x] <= 0 for x in shards):
        return None
    noted = spark.createDataFrame([(x, files[x]) for x in shards], "path string, noted long")
    there = noted.join(listing(spark, root, pattern), "path", "left")
    odd = there.filter(~F.col("noted").eqNullSafe(F.col("n_bytes"))).head(1)
    return None if odd else [f"{root}/{x}" for x in shards]


def release_manifest(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, n_bytes and sha256 of every file to be released."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").lstrip("/")
    return files.select(F.regexp_replace("path", f"^[a-z]*:/*{base}/", "").alias("path"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def safe_members(names: DataFrame) -> DataFrame:
    """name and whether an archive member (name, is_link) may be unpacked: no link, no way out of its folder."""
    escapes = F.col("name").startswith("/") | F.col("name").rlike(r"(^|/)\.\.(/|$)") | F.coalesce(F.col("is_link"), F.lit(False))
    return names.select("name", (~escapes).alias("safe"))

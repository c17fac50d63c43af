"""Overlays: texts generated for targets, appended in parts and taken up again where they stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import canonical_hash, sha256
from ..functions.text import stripped
from ..sources.tables import ContractError, exists, require_columns
from .validation import require_unique

# The types of an overlay's columns.
SCHEMA = "audio_id string, target_id string, official_target_id string, split string, text string, finish_reason string, truncated boolean, generated_token_count long, recipe_sha256 string"
SOURCE = ["audio_id", "target_id", "target_type", "text", "split"]

Generator = Callable[[list[str]], list[tuple[str, str, int]]]


def source_targets(df: DataFrame, types: list[str]) -> DataFrame:
    """Targets of these types; their ids are unique, their texts not blank, and there are some."""
    if not types:
        raise ContractError("no target type is given")
    rows = require_columns(df, SOURCE).filter(F.col("target_type").isin(*sorted(set(types))))
    require_unique(rows, "target_id")
    if bad := rows.filter(F.coalesce(stripped(F.col("text")), F.lit("")) == "").head(1):
        raise ContractError(f"the target {bad[0]['target_id']} has no text")
    if rows.isEmpty():
        raise ContractError(f"no targets of types {types}")
    return rows


def recipe_hash(**settings: object) -> str:
    """Identity of how texts are made."""
    return canonical_hash(settings)


def completed(spark: SparkSession, path: str) -> DataFrame:
    """official_target_id and truncated of the parts written so far; a target in two of them is an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], "official_target_id string, truncated boolean")
    rows = spark.read.parquet(path).select("official_target_id", "truncated")
    require_unique(rows, "official_target_id")
    return rows


def generate(rows: DataFrame, make: Generator, recipe: str, at_once: int = 64) -> DataFrame:
    """Overlay rows of targets by make(texts) -> (text, finish_reason, tokens) of each; another number of them is an error."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for x in range(0, len(frame), at_once):
                part = frame.iloc[x : x + at_once]
                made = make(part["text"].tolist())
                if len(made) != len(part):
                    raise ContractError(f"{len(made)} texts for {len(part)} requests")
                texts, reasons, counts = zip(*made, strict=True)
                yield pd.DataFrame({"audio_id": part["audio_id"], "official_target_id": part["target_id"], "split": part["split"], "text": [t.strip() for t in texts], "finish_reason": reasons, "generated_token_count": counts})

    made = rows.mapInPandas(parts, "audio_id string, official_target_id string, split string, text string, finish_reason string, generated_token_count long")
    target = F.concat(F.lit("response-"), F.substring(sha256(F.concat_ws("\0", "official_target_id", F.lit(recipe))), 1, 24))
    whole = made.withColumns({"target_id": target, "truncated": F.col("finish_reason") == "length", "recipe_sha256": F.lit(recipe)})
    return whole.select(*(x.split()[0] for x in SCHEMA.split(", ")))


def expand(targets: DataFrame, make: Generator, path: str, recipe: str, limit: int | None = None) -> DataFrame:
    """Generates what a folder of parts lacks of targets and appends it; returns all of its rows.

    Targets that are written but not asked for are an error, as are parts of another recipe. With a limit the first ones by id are made.
    """
    spark = targets.sparkSession
    wanted = targets.orderBy("target_id").limit(limit) if limit is not None else targets
    done = completed(spark, path)
    if odd := done.join(wanted, done["official_target_id"] == wanted["target_id"], "left_anti").head(1):
        raise ContractError(f"the target {odd[0][0]} is written but not in the source")
    if exists(spark, path) and spark.read.parquet(path).filter(F.col("recipe_sha256") != recipe).head(1):
        raise ContractError("the parts were made by another recipe")
    open_rows = wanted.join(done, wanted["target_id"] == done["official_target_id"], "left_anti")
    if not open_rows.isEmpty():
        generate(open_rows, make, recipe).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)

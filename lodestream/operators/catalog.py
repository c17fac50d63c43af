"""Catalogs: audio rows joined to typed targets, picked, filtered and described."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import stable_bucket
from .validation import MissingRows, duplicates


def audio_rows(df: DataFrame) -> DataFrame:
    """Audio rows in their types; no splits are an empty list."""
    kinds = {"audio_id": "string", "dataset": "string", "flac_sha256": "string", "flac_size": "long", "source_id": "string", "target_count": "long", "wds_key": "string", "wds_shard": "string"}
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in kinds.items()), F.coalesce(F.col("splits").cast("array<string>"), F.array().cast("array<string>")).alias("splits"))


def target_rows(df: DataFrame) -> DataFrame:
    """Target rows in their types; empty provenance is null, no review status empty."""
    plain = ("audio_id", "target_id", "target_type", "text", "split", "source")
    origin = ("generator_model", "generator_revision", "prompt_sha256")
    return df.select(*(F.col(c).cast("string").alias(c) for c in plain), *(F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in origin), F.coalesce(F.col("review_status").cast("string"), F.lit("")).alias("review_status"))


def in_splits(splits: str, wanted: list[str]) -> Column:
    """Whether a row belongs to any of these splits."""
    return F.arrays_overlap(splits, F.array(*map(F.lit, wanted)))


def first_split(splits: str, wanted: list[str]) -> Column:
    """Whether a row's first split is one of these."""
    return F.coalesce(F.try_element_at(splits, F.lit(1)).isin(*wanted), F.lit(False))


def exclusion_rate(skipped: Column, kept: Column) -> Column:
    """The share of rows that were skipped; of no rows none."""
    return skipped / F.greatest(skipped + kept, F.lit(1))


def united(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """The rows of several datasets as one bag, each with its dataset's name."""
    each = [df.withColumn(name, F.lit(k)) for k, df in parts.items()]
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out


def allowed_status(column: str, allowed: list[str] | None) -> Column:
    """Whether a review status is allowed; without a list all are."""
    return F.lit(True) if allowed is None else F.col(column).isin(allowed)


def nested_index(audio: DataFrame, targets: DataFrame, key: str, order: str, kind: Column, captions: str, transcript: str, value: str) -> DataFrame:
    """audio with captions (array of order and value, in order) and transcript (the one of least order), null-safe where there are none.

    Targets add up per key before they are shuffled to the audio rows.
    """
    entry = F.struct(F.col(order), F.col(value))
    nested = targets.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(kind == captions, entry))).alias("captions"),
        F.min(F.when(kind == transcript, entry)).alias("transcript"),
        F.count_if(kind == transcript).alias("n_transcripts"),
    )
    joined = audio.join(nested, key, "left")
    none = F.array().cast(nested.schema["captions"].dataType)
    return joined.withColumns({"captions": F.coalesce("captions", none), "n_transcripts": F.coalesce("n_transcripts", F.lit(0).cast("long"))})


def stable_pick(df: DataFrame, values: str, seed: int, epoch: int, key: str) -> Column:
    """The element of a sorted array that seed, epoch and key choose; null if it is empty."""
    n = F.size(values)
    return F.when(n > 0, F.try_element_at(F.col(values), (stable_bucket(seed, epoch, F.col(key), F.greatest(n, F.lit(1))) + 1).cast("int")))


def paired_sources(targets: DataFrame, key: str, kind: str, left: str, right: str) -> DataFrame:
    """Targets of one kind joined to the one target of another kind of their key; that one must be there and be the only one."""
    style, spoken = targets.filter(F.col(kind) == left), targets.filter(F.col(kind) == right)
    if found := duplicates(spoken, key).head(1):
        raise MissingRows(f"several {right} targets of {found[0][0]}")
    if found := style.join(spoken, key, "left_anti").head(1):
        raise MissingRows(f"no {right} target of {found[0][key]}")
    return style.alias("a").join(spoken.alias("b"), key)


def histogram(df: DataFrame, value: Column, name: str) -> DataFrame:
    """How many rows have each value."""
    return df.groupBy(value.alias(name)).agg(F.count("*").alias("n_rows"))


def stale_rows(catalog: DataFrame, sidecar: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows whose digest the sidecar has otherwise."""
    other = sidecar.select(key, F.col(digest).alias("sidecar_digest"))
    return catalog.join(other, key).filter(~F.col(digest).eqNullSafe(F.col("sidecar_digest")))


def same_targets(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that only one of two target tables has, and which."""
    left, right = a.select(*columns).distinct(), b.select(*columns).distinct()
    return left.exceptAll(right).withColumn("only_in", F.lit("left")).union(right.exceptAll(left).withColumn("only_in", F.lit("right")))

"""Losses, scores and quantiles as aggregates over full denominators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import running_sum


def token_nll(df: DataFrame, by: str, loss: str, tokens: str) -> DataFrame:
    """One row: loss over tokens, the mean of targets' own losses a token, and the mean of the means of each key."""
    own = F.col(loss) / F.col(tokens)
    each = df.groupBy(by).agg(F.sum(loss).alias("l"), F.sum(tokens).alias("t"), F.sum(own).alias("o"), F.count(own).alias("n"))
    return each.agg(
        (F.sum("l") / F.sum("t")).alias("token_nll"),
        (F.sum("o") / F.sum("n")).alias("target_nll"),
        F.avg(F.col("o") / F.col("n")).alias("key_nll"),
        F.sum("n").alias("n_targets"),
        F.count("*").alias("n_keys"),
    )


def exact_quantiles(df: DataFrame, value: str, shares: list[float], rule: str = "round") -> DataFrame:
    """share and value at index (n - 1) * share of the sorted values: rounded half to even, or cut."""
    if rule not in ("round", "floor"):
        raise ValueError(f"unknown rule: {rule}")
    # Counts by value add up before the shuffle, so a value that most rows have is one row here.
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_n"))
    placed = running_sum(counts, [F.col(value)], "_n", "_end")
    n = placed.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if not n:
        return df.sparkSession.createDataFrame([], f"share double, {value} {df.schema[value].dataType.simpleString()}")
    at = [(q, round((n - 1) * q) if rule == "round" else min(n - 1, math.floor(q * (n - 1)))) for q in shares]
    wanted = F.array(*(F.struct(F.lit(q).alias("share"), F.lit(k).cast("long").alias("at")) for q, k in at))
    here = F.filter(wanted, lambda w: (w["at"] < F.col("_end")) & (w["at"] >= F.col("_end") - F.col("_n")))
    return placed.select(F.explode(here).alias("w"), value).select(F.col("w.share").alias("share"), value)


def macro_mean(df: DataFrame, category: str, value: Column) -> DataFrame:
    """One row: the unweighted mean of categories' means, a missing value counting as zero."""
    each = df.groupBy(category).agg(F.avg(F.coalesce(value, F.lit(0.0))).alias("mean"))
    return each.agg(F.avg("mean").alias("score"), F.count("*").alias("n_categories"))


def label_distribution(df: DataFrame, label: str, points: dict[str, float]) -> DataFrame:
    """label, n_rows, share of all rows (unusable ones too) and what its rows add to the score."""
    spark = df.sparkSession
    kinds = spark.createDataFrame(sorted(points.items()), "label string, points double")
    total = df.agg(F.count("*").alias("total"))  # one row
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n_rows"))
    joined = F.broadcast(kinds).join(counts, "label", "left").join(F.broadcast(total), F.lit(True))
    n = F.coalesce("n_rows", F.lit(0)).cast("long")
    return joined.select("label", n.alias("n_rows"), (n / F.nullif("total", F.lit(0))).alias("share"), (n * F.col("points") / F.nullif("total", F.lit(0))).alias("score"))


def range_check(scores: DataFrame, profile: DataFrame) -> DataFrame:
    """profile (metric, expected, minimum, maximum) with value and status: pass, fail or missing."""
    joined = profile.join(scores.select("metric", "value"), "metric", "left")
    status = F.when(F.col("value").isNull(), "missing").when(F.col("value").between(F.col("minimum"), F.col("maximum")), "pass").otherwise("fail")
    return joined.withColumn("status", status)


def throughput(df: DataFrame, capacity: int) -> DataFrame:
    """One row of a training update's packs (tokens, supervised, loss, elapsed, waited)."""
    seconds = F.sum("elapsed")
    return df.agg(
        (F.sum("loss") / F.nullif(F.sum("supervised"), F.lit(0))).alias("nll"),
        (F.sum("tokens") / (F.count("*") * capacity)).alias("utilisation"),
        (F.sum("tokens") / F.nullif(seconds, F.lit(0.0))).alias("tokens_per_second"),
        (F.sum("tokens") / F.nullif(seconds + F.sum("waited"), F.lit(0.0))).alias("tokens_per_second_waiting"),
    )

"""Rates, schedules and vector arithmetic as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def perplexity(nll: Column) -> Column:
    """exp of nll, which counts as 20 at most."""
    return F.exp(F.least(nll, F.lit(20.0)))


def learning_rate_scale(update: Column, warmup: int, last: int, base: float, least: float) -> Column:
    """Linear warm-up, then a cosine from 1 to least / base."""
    low = least / base
    at = F.least(F.greatest((update - warmup) / F.lit(max(1, last - warmup)), F.lit(0.0)), F.lit(1.0))
    cosine = F.lit(low) + (1 - low) * 0.5 * (1 + F.cos(F.lit(math.pi) * at))
    return F.when(update < warmup, (update + 1) / F.lit(float(warmup))).otherwise(cosine) if warmup else cosine


def dot(a: Column, b: Column) -> Column:
    """Inner product, added from left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def rms(values: Column) -> Column:
    return F.sqrt(dot(values, values) / F.size(values))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def rms_norm(values: Column, weights: Column, eps: float = 1e-6) -> Column:
    scale = F.sqrt(dot(values, values) / F.size(values) + eps)
    return F.zip_with(values, weights, lambda x, w: w * x / scale)


def full_mean(value: Column) -> Column:
    """Mean over all rows; a missing value counts as zero, as an unusable answer is a wrong one."""
    return F.avg(F.coalesce(value.cast("double"), F.lit(0.0)))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0))

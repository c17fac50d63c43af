"""Contracts as actions of their own: each check is an aggregate that returns its violations, never an expression that the
optimiser may prune."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ContractError


class DuplicateKey(ContractError):
    """A key that must be unique isn't."""


class LeakageError(ContractError):
    """A row belongs to splits that must be apart."""


class MissingRows(ContractError):
    """Rows that another table names aren't there."""


class LimitExceeded(ContractError):
    """More bad rows than are allowed."""


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, and n_rows."""
    return df.groupBy(*key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def require_unique(df: DataFrame, *key: str) -> None:
    if found := duplicates(df, *key).head(1):
        raise DuplicateKey(f"{', '.join(key)} repeats: {found[0].asDict()}")


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Rows of wanted whose key have lacks."""
    return wanted.join(have.select(key), key, "left_anti")


def require_covered(wanted: DataFrame, have: DataFrame, key: str) -> None:
    if found := missing(wanted, have, key).select(key).head(1):
        raise MissingRows(f"no row for {key} {found[0][0]}")


def faults(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rule and n_rows: how many rows break each rule (an expression that says what is right), all in one pass.

    What can't be told (null) breaks a rule.
    """
    broken = {k: F.count_if(~F.coalesce(v, F.lit(False))).alias(k) for k, v in checks.items()}
    names = list(checks)
    one = df.agg(*broken.values())
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("n_rows")) for k in names))).alias("x")).select("x.rule", "x.n_rows")


def require_none(found: DataFrame) -> None:
    """Raises for the first rule that rows break."""
    if bad := found.filter("n_rows > 0").orderBy("rule").head(1):
        raise ContractError(f"{bad[0]['n_rows']} rows break the rule {bad[0]['rule']}")


def require_at_most(df: DataFrame, bad: Column, limit: int) -> None:
    """Raises if more than limit rows are bad."""
    n = df.filter(bad).limit(limit + 1).count()
    if n > limit:
        raise LimitExceeded(f"more than {limit} bad rows")


def overlaps(df: DataFrame, splits: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """One row: for each pair of splits, how many rows belong to both."""
    return df.agg(*(F.count_if(F.array_contains(splits, a) & F.array_contains(splits, b)).alias(f"{a}_{b}") for a, b in pairs))


def require_apart(df: DataFrame, splits: str, pairs: list[tuple[str, str]]) -> None:
    counts = overlaps(df, splits, pairs).first().asDict()
    if bad := {k: n for k, n in counts.items() if n}:
        raise LeakageError(f"splits overlap: {bad}")

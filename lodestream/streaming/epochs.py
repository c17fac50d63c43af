"""Epochs over streams: each is read to its end, and its last group is closed though it isn't full."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.packing import accumulation_groups
from ..sources.tables import ContractError
from .commits import commit_once


def updates(stream: Callable[[], DataFrame], key: str, weight: str, target: float, most_items: int, most_updates: int, path: str) -> DataFrame:
    """update, epoch, n_items and weight of groups of rows, in order of their key, epoch after epoch until there are most_updates.

    Within an epoch a key is committed once; the next one begins anew. A stream that has nothing is an error.
    """
    parts, done, epoch = [], 0, 0
    while done < most_updates:
        rows = commit_once(stream(), key, epoch, path=path).withColumn("_stream", F.lit(0))
        groups = accumulation_groups(rows, "_stream", [key], weight, target, most_items, "group")
        each = groups.groupBy("group").agg(F.count("*").alias("n_items"), F.sum(weight).alias("weight"))
        n = (each.agg(F.max("group")).first()[0] or 0) + 1 if not rows.isEmpty() else 0
        if not n:
            raise ContractError("the stream holds no rows")
        kept = each.filter(F.col("group") < most_updates - done)
        parts.append(kept.select((F.col("group") + done).alias("update"), F.lit(epoch).alias("epoch"), "n_items", "weight"))
        done, epoch = done + n, epoch + 1
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def evaluated(done: DataFrame, every: int, evaluate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """evaluate() over the rows of updates (update, ...) after which an evaluation is due: each that completes so many."""
    if every <= 0:
        raise ContractError("evaluations must be some updates apart")
    return evaluate(done.filter((F.col("update") + 1) % every == 0))

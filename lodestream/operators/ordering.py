"""Positions, shuffles, stripes and interleaving without putting a table or a group into one task.

A global position comes from range partitions: rows are sorted within each, numbered there, stored, and each partition's number of
rows (one number a partition, all that the driver sees) shifts the next one's.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..sources.tables import store

_SHIFT = 33  # of the partition in monotonically_increasing_id()


def _sorted_parts(df: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, list[tuple[int, int]]]:
    """df sorted over range partitions and stored, with columns _part and _at, and the partitions' row counts."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = store(rows.select("*", F.shiftrightunsigned("_id", _SHIFT).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << _SHIFT) - 1)).alias("_at")).drop("_id"), name)
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect())
    return rows, counts


def _with_part(rows: DataFrame, values: dict[int, object], name: str, kind: str = "bigint") -> DataFrame:
    """rows with a value for their partition; there is one row a partition to broadcast."""
    found = rows.sparkSession.createDataFrame(sorted(values.items()), f"_part bigint, {name} {kind}")
    return rows.join(F.broadcast(found), "_part", "left")


def with_positions(df: DataFrame, order: list[Column], conditions: dict[str, Column]) -> DataFrame:
    """df with, for each name, a row's place (from 0) in the given order among the rows that fulfil its condition; null if it doesn't."""
    marked = df.withColumns({f"_if_{name}": F.coalesce(c, F.lit(False)) for name, c in conditions.items()})
    rows, _ = _sorted_parts(marked, order, "positions")
    counts = sorted(rows.groupBy("_part").agg(*(F.count_if(f"_if_{name}").alias(name) for name in conditions)).collect())
    for k, name in enumerate(conditions):
        before = dict(zip([r["_part"] for r in counts], accumulate([0, *(r[k + 1] for r in counts)]), strict=False))
        rows = _with_part(rows, before, f"_before_{name}")
    here = W.partitionBy("_part").orderBy("_at")
    places = {name: F.when(F.col(f"_if_{name}"), F.col(f"_before_{name}") + F.count_if(F.col(f"_if_{name}")).over(here) - 1) for name in conditions}
    return rows.select(*df.columns, *(c.cast("long").alias(name) for name, c in places.items()))


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with each row's place (from 0) in the given order, which must be total."""
    rows, counts = _sorted_parts(df, order, name)
    before = dict(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0), strict=False))
    placed = _with_part(rows, before, "_before").withColumn(name, (F.col("_at") + F.col("_before")).cast("long"))
    return placed.select(*df.columns, name)


def with_group_position(df: DataFrame, group: str, order: list[Column], name: str = "position", size: str | None = None) -> DataFrame:
    """df with each row's place (from 0) in its group, and the group's size if a name is given; a group may be larger than a task."""
    rows = with_position(df, [F.col(group), *order], "_place")
    first = rows.groupBy(F.col(group).alias("_group")).agg(F.min("_place").alias("_first"), F.count("*").alias(size or "_size"))
    placed = rows.join(first, rows[group].eqNullSafe(first["_group"])).withColumn(name, F.col("_place") - F.col("_first"))
    return placed.select(*df.columns, name, *([size] if size else []))


def running_min(df: DataFrame, order: list[Column], value: str, name: str = "best") -> DataFrame:
    """df with the least value so far in the given order."""
    rows, _ = _sorted_parts(df, order, name)
    least = {r["_part"]: r["m"] for r in rows.groupBy("_part").agg(F.min(value).alias("m")).collect()}
    before, now = {}, None
    for part in sorted(least):
        before[part] = now
        now = min((x for x in (now, least[part]) if x is not None), default=None)
    own = F.min(value).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    kind = df.schema[value].dataType.simpleString()
    return _with_part(rows.withColumn("_own", own), before, "_before", kind).withColumn(name, F.least("_own", "_before")).select(*df.columns, name)


def running_sum(df: DataFrame, order: list[Column], value: str, name: str = "total") -> DataFrame:
    """df with the sum of the values up to and with each row in the given order."""
    rows, _ = _sorted_parts(df, order, name)
    sums = {r["_part"]: r["s"] or 0 for r in rows.groupBy("_part").agg(F.sum(value).alias("s")).collect()}
    before = dict(zip(sorted(sums), accumulate((sums[p] for p in sorted(sums)), initial=0), strict=False))
    own = F.sum(value).over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    placed = _with_part(rows.withColumn("_own", F.coalesce(own, F.lit(0))), before, "_before", rows.agg(F.sum(value).alias("s")).schema["s"].dataType.simpleString())
    return placed.withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)


def shuffled(df: DataFrame, seed: int, epoch: int, *keys: str, name: str = "position") -> DataFrame:
    """df with each row's place in a shuffle that seed and epoch fix."""
    return with_position(df, [order_key(seed, epoch, *map(F.col, keys)), *map(F.col, keys)], name)


def block_shuffled(df: DataFrame, seed: int, epoch: int, order: list[Column], block: int, *keys: str, name: str = "position") -> DataFrame:
    """As shuffled(), but no row leaves its block of consecutive rows: a shuffle through a bounded buffer."""
    placed = with_position(df, order, "_given")
    return with_position(placed.withColumn("_block", F.floor(F.col("_given") / block)), [F.col("_block"), order_key(seed, epoch, *map(F.col, keys)), F.col("_given")], name).drop("_given", "_block")


def stripes(shards: DataFrame, seed: int, epoch: int, key: str, world: int, workers: int) -> DataFrame:
    """Shards in shuffled order, each with the rank and the worker that reads it."""
    placed = shuffled(shards.select(key).distinct(), seed, epoch, key)
    worker = F.pmod(F.floor(F.col("position") / world), F.lit(workers))
    return placed.select("*", F.pmod("position", F.lit(world)).cast("int").alias("rank"), worker.cast("int").alias("worker"))


def interleaved(df: DataFrame, source: str, order: list[Column], seed: int, name: str = "position") -> DataFrame:
    """Sources mixed evenly, each in its own order and each row once: by the share of its source that a row has reached."""
    placed = with_group_position(df, source, order, "_at_source", "_size")
    share = (F.col("_at_source") * 2 + 1) / (F.col("_size") * 2)
    ties = order_key(seed, 0, F.coalesce(F.col(source).cast("string"), F.lit("")))
    return with_position(placed.withColumn("_share", share), [F.col("_share"), ties, F.col("_at_source")], name).drop("_size", "_share", "_at_source")


def synchronised(df: DataFrame, rank: str, order: list[Column], name: str = "step") -> DataFrame:
    """The rows of each rank up to the number that the shortest rank has, so that all end together."""
    placed = with_group_position(df, rank, order, name)
    least = placed.groupBy(rank).agg(F.count("*").alias("n")).agg(F.min("n").alias("_least"))  # one row
    return placed.join(F.broadcast(least), F.col(name) < F.col("_least")).drop("_least")


def last_kept(df: DataFrame, group: str, order: list[Column], n: int, protected: Column) -> DataFrame:
    """The last n rows of each group, and those that are protected."""
    placed = with_group_position(df, group, order, "_at", "_size")
    return placed.filter((F.col("_at") >= F.col("_size") - n) | F.coalesce(protected, F.lit(False))).drop("_size", "_at")


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of a total order: each task keeps n of its own."""
    return df.orderBy(*order).limit(n)

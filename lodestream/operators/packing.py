"""Packing by windows, chunking of streams and token layouts.

Windows are consecutive rows of a worker's stream; a window is a group of bounded size, so grouped Arrow functions hold it. Chunks
depend on all rows before them, but a chunk has a bounded number of rows: a long stream is cut into blocks, each block tells for
every place where its first chunk may begin where its last one ends, these tables are composed in order, and then each block numbers
its rows. Shorter streams are read in order by one task with a state of constant size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.audio import RATE
from ..sources.tables import ContractError
from .ordering import with_group_position, with_positions

IGNORED_LABEL = -100
#: Rows of a stream from which it is cut into blocks, and rows of a block.
BLOCKS_FROM, BLOCK_ROWS = 1 << 20, 1 << 16


class OversizedExample(ContractError):
    """An example is longer than may be packed; nothing is cut."""


def best_fit(lengths: list[int], capacity: int, most_items: int | None = None) -> list[int]:
    """The bin of each item: longest first (ties as given), each into the fullest bin that takes it, else into a new one.

    Of equally full bins the oldest is taken; bins are numbered by their first item as given.
    """
    open_bins: list[tuple[int, int]] = []  # room left and number, ascending
    items: list[int] = []
    out = [0] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at = bisect_left(open_bins, (lengths[k], -1))
        if at < len(open_bins):
            room, own = open_bins.pop(at)
        else:
            room, own = capacity, len(items)
            items.append(0)
        items[own] += 1
        out[k] = own
        if most_items is None or items[own] < most_items:
            insort(open_bins, (room - lengths[k], own))
    order: dict[int, int] = {}
    for own in out:
        order.setdefault(own, len(order))
    return [order[own] for own in out]


def windows(df: DataFrame, stream: str, order: list[Column], size: int) -> DataFrame:
    """df with ordinal (place in the stream) and window (of so many consecutive rows)."""
    placed = with_group_position(df, stream, order, "ordinal")
    return placed.withColumn("window", F.floor(F.col("ordinal") / size).cast("long"))


def packed(df: DataFrame, stream: str, length: str, capacity: int | str, most_items: int | None = None, longest: int | None = None, oversized: str = "skip") -> DataFrame:
    """Rows with columns stream, window, ordinal and length, each with its pack (numbered in its window).

    Rows longer than longest (capacity, if not given) are left out, or raise an error. A capacity that is a name is a column, one
    value a stream.
    """
    own = F.col(capacity) if isinstance(capacity, str) else F.lit(capacity)
    limit = F.least(own, F.lit(longest)) if longest else own
    if oversized not in ("skip", "error"):
        raise ValueError(f"unknown way with oversized rows: {oversized}")
    if oversized == "error" and (bad := df.filter(F.col(length) > limit).select(length, limit).head(1)):
        raise OversizedExample(f"an example of {bad[0][0]} tokens; the limit is {bad[0][1]}")
    rows = df.filter(F.col(length) <= limit).select("*", F.lit(0).alias("pack"))

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by("ordinal")
        room = group.column(capacity)[0].as_py() if isinstance(capacity, str) else capacity
        packs = best_fit(group.column(length).to_pylist(), room, most_items)
        return group.set_column(group.schema.get_field_index("pack"), "pack", pa.array(packs, pa.int32()))

    return rows.groupBy(stream, "window").applyInArrow(fill, rows.schema)


_COUNTS = ("n_packs", "n_items", "n_oversized", "tokens", "lower_bound")


def grid(df: DataFrame, order: list[Column], length: str, capacities: list[int], sizes: list[int]) -> DataFrame:
    """capacity, size and statistics of each pair of them over all rows in an order, rows that are too long left out before windows.

    The rows are sorted once, and all pairs' windows are packed together.
    """
    placed = with_positions(df.select(F.col(length).alias("length"), *(c.alias(f"_o{k}") for k, c in enumerate(order))), [F.col(f"_o{k}") for k in range(len(order))], {f"_at_{c}": F.col("length") <= c for c in capacities})
    pairs = [F.struct(F.lit(c).alias("capacity"), F.lit(s).alias("size"), F.col(f"_at_{c}").alias("ordinal")) for c in capacities for s in sizes]
    each = placed.select("length", F.explode(F.array(*pairs)).alias("p")).select("length", "p.*").filter("ordinal is not null")
    each = each.withColumns({"window": F.floor(F.col("ordinal") / F.col("size")).cast("long"), "pair": F.concat_ws(":", "capacity", "size")})
    return pack_stats(packed(each, "pair", "length", "capacity"), ["capacity", "size"], "pair", "length", "capacity")


def pack_stats(packs: DataFrame, by: list[str], stream: str, length: str, capacity: int | str, given: DataFrame | None = None) -> DataFrame:
    """n_packs, n_items, tokens, utilisation, items_per_pack and lower_bound of packed rows; the bound is summed over streams.

    With the rows as given before packing also n_oversized, those of them longer than capacity.
    """
    own = [*by, *([stream] if stream not in by else [])]
    each = packs.groupBy(*own, "window", "pack").agg(F.count("*").alias("items"), F.sum(length).alias("used"))
    stats = each.groupBy(*own).agg(F.count("*").alias("n_packs"), F.sum("items").alias("n_items"), F.sum("used").alias("tokens"))
    room = F.col(capacity) if isinstance(capacity, str) else F.lit(capacity)
    stats = stats.withColumn("lower_bound", F.ceil(F.col("tokens") / room).cast("long"))
    if given is not None:
        over = given.groupBy(*own).agg(F.count_if(F.col(length) > room).alias("n_oversized"))
        stats = over.join(stats, own, "left").na.fill(0, ["n_packs", "n_items", "tokens", "lower_bound"])
    return merge_stats(stats, by, room)


def merge_stats(stats: DataFrame, by: list[str], capacity: Column) -> DataFrame:
    """Statistics of several streams or workers as those of all of them, by some columns: counts add up, ratios follow from them."""
    counts = [c for c in _COUNTS if c in stats.columns]
    total = stats.groupBy(*by).agg(*(F.sum(c).alias(c) for c in counts))
    utilisation, items = F.try_divide("tokens", F.col("n_packs") * capacity), F.try_divide("n_items", "n_packs")
    return total.select(*by, *(c for c in counts if c != "lower_bound"), utilisation.alias("utilisation"), items.alias("items_per_pack"), "lower_bound")


def _longest(df: DataFrame, stream: str) -> int:
    return df.groupBy(stream).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]


class _Chunks:
    """Where the chunks of one block begin: behind(weights, at) is the place behind the chunk that begins at a place."""

    def __init__(self, weights: list, size: int, behind):
        self.weights, self.size, self.behind = weights, size, behind
        self.after: dict[int, tuple[int, int, int]] = {}  # place: the next chunk's, where the last one of the block ends, chunks

    def end(self, at: int) -> tuple[int, int]:
        """For a chunk that begins at a place: where the block's last chunk ends, counted from the block's end, and how many there are."""
        path = []
        while at < self.size and at not in self.after:
            path.append((at, self.behind(self.weights, at)))
            at = path[-1][1]
        _, stop, n = self.after[at] if at < self.size else (at, at - self.size, 0)
        for own, following in reversed(path):
            n += 1
            self.after[own] = following, stop, n
        return stop, n


def _by_blocks(df: DataFrame, stream: str, order: list[str], weight: str, name: str, most_items: int, behind, block_rows: int) -> DataFrame:
    """Numbers chunks of at most most_items rows by blocks of a stream."""
    block_rows = max(block_rows, 4 * most_items)
    kind, names, of_stream = dict(df.dtypes)[stream], [*df.columns, name], "_stream"
    while of_stream in names:  # the caller's own may be named so
        of_stream = f"_{of_stream}"
    rows = with_group_position(df, stream, [F.col(c) for c in order], "_at").withColumn("_block", F.floor(F.col("_at") / block_rows).cast("long"))
    narrow = rows.select(stream, "_block", "_at", F.coalesce(F.col(weight), F.lit(0)).alias("_w"))
    ahead = narrow.filter((F.col("_at") % block_rows < most_items) & (F.col("_block") > 0)).withColumn("_block", F.col("_block") - 1)

    def summary(group: pa.Table) -> pa.Table:
        group = group.sort_by("_at")
        at, own = group.column("_at").to_pylist(), group.column("_block")[0].as_py()
        chunks = _Chunks(group.column("_w").to_pylist(), sum(x < (own + 1) * block_rows for x in at), behind)
        entries = range(min(most_items, chunks.size) + 1 if own else 1)
        stops, counts = zip(*(chunks.end(e) for e in entries), strict=True)
        n = len(entries)
        return pa.table({stream: group.column(stream).slice(0, 1).combine_chunks().take(pa.array([0] * n)), "_block": [own] * n, "_entry": list(entries), "_stop": stops, "_n": counts})

    tables = narrow.unionByName(ahead).groupBy(stream, "_block").applyInArrow(summary, f"`{stream}` {kind}, _block long, _entry long, _stop long, _n long")

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, entry, number = object(), 0, 0
        for batch in batches:
            kept = []
            columns = [x.to_pylist() for x in batch.columns]
            for k, (group, own, at, stop, n) in enumerate(zip(*columns, strict=True)):
                if group != last:
                    last, entry, number, seen = group, 0, 0, -1
                if own != seen and at == entry:
                    kept.append((k, entry, number))
                    entry, number, seen = stop, number + n, own
            if kept:
                index, entries, numbers = zip(*kept, strict=True)
                part = batch.select([0, 1]).take(pa.array(index))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(entries, pa.int64()), pa.array(numbers, pa.int64())], names=[stream, "_block", "_entry", "_first"])

    # One row for each block and place where its first chunk may begin: a stream's are few, and read in order.
    starts = tables.repartition(stream).sortWithinPartitions(stream, "_block", "_entry").mapInArrow(composed, f"`{stream}` {kind}, _block long, _entry long, _first long")
    starts = starts.select(F.col(stream).alias(of_stream), F.col("_block").alias("_of"), "_entry", "_first")
    joined = rows.join(starts, rows[stream].eqNullSafe(starts[of_stream]) & (rows["_block"] == starts["_of"])).withColumn(name, F.lit(0).cast("long"))

    def numbered(group: pa.Table) -> pa.Table:
        group = group.sort_by("_at")
        weights = [x or 0 for x in group.column(weight).to_pylist()]
        at, number = group.column("_entry")[0].as_py(), group.column("_first")[0].as_py()
        out = [number - 1] * min(at, len(weights))
        while at < len(weights):
            to = min(behind(weights, at), len(weights))
            out += [number] * (to - at)
            at, number = to, number + 1
        return group.set_column(group.schema.get_field_index(name), name, pa.array(out, pa.int64())).select(names)

    schema = joined.select(*names).schema
    return joined.groupBy(stream, "_block").applyInArrow(numbered, schema)


def _streamed(df: DataFrame, stream: str, order: list[str], weight: str, name: str, step) -> DataFrame:
    """Each stream in order through step(state, weight) -> (state, number); state is None where a stream begins."""
    rows = df.withColumn(name, F.lit(0).cast("long"))
    at, own = rows.columns.index(stream), rows.columns.index(weight)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, object()
        for batch in batches:
            out = []
            for group, value in zip(batch.column(at).to_pylist(), batch.column(own).to_pylist(), strict=True):
                if group != last:
                    state, last = None, group
                state, number = step(state, value or 0)
                out.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.int64())], names=batch.schema.names)

    return rows.repartition(stream).sortWithinPartitions(stream, *order).mapInArrow(numbered, rows.schema)


def request_chunks(df: DataFrame, stream: str, order: list[str], weight: str, most_items: int, budget: float, name: str = "chunk") -> DataFrame:
    """Consecutive rows of a stream in chunks: one closes before a row that would exceed its items or its budget."""

    def behind(weights, at):
        total, to, stop = weights[at], at + 1, min(at + most_items, len(weights))
        while to < stop and total + weights[to] <= budget:
            total, to = total + weights[to], to + 1
        return to

    if _longest(df, stream) >= BLOCKS_FROM:
        return _by_blocks(df, stream, order, weight, name, most_items, behind, BLOCK_ROWS)

    def step(state, value):
        number, items, total = state or (0, 0, 0)
        if items and not (items < most_items and total + value <= budget):  # so that NaN exceeds it
            number, items, total = number + 1, 0, 0
        return (number, items + 1, total + value), number

    return _streamed(df, stream, order, weight, name, step)


def accumulation_groups(df: DataFrame, stream: str, order: list[str], weight: str, target: float, most_items: int, name: str = "group") -> DataFrame:
    """Consecutive rows of a stream in groups: one closes after the row that reaches its target or its items."""

    def behind(weights, at):
        total, to, stop = 0, at, min(at + most_items, len(weights))
        while to < stop and total < target:
            total, to = total + weights[to], to + 1
        return max(to, at + 1)

    if _longest(df, stream) >= BLOCKS_FROM:
        return _by_blocks(df, stream, order, weight, name, most_items, behind, BLOCK_ROWS)

    def step(state, value):
        number, items, total = state or (0, 0, 0)
        items, total = items + 1, total + value
        if total >= target or items >= most_items:
            return (number + 1, 0, 0), number
        return (number, items, total), number

    return _streamed(df, stream, order, weight, name, step)


def in_flight(df: DataFrame, stream: str, order: list[str], seconds: str, capacity: float, most_items: int, name: str = "wave", oversized: str = "error") -> DataFrame:
    """Consecutive requests of a stream in waves whose audio is held at once: no wave of several requests exceeds capacity seconds.

    A request counts a sample at least; one that exceeds the capacity by itself is an error, or has a wave of its own if oversized is
    "alone".
    """
    if capacity <= 0:
        raise ContractError("the capacity must be positive")
    if oversized not in ("error", "alone"):
        raise ValueError(f"unknown way with oversized requests: {oversized}")
    charged = df.withColumn("_charge", F.greatest(F.coalesce(F.col(seconds).cast("double"), F.lit(0.0)), F.lit(1.0 / RATE)))
    if oversized == "error" and (bad := charged.filter(F.col("_charge") > capacity + 1e-9).select("_charge").head(1)):
        raise ContractError(f"a request of {bad[0][0]:.3f} seconds exceeds {capacity:.3f}")
    return request_chunks(charged, stream, order, "_charge", most_items, capacity + 1e-9, name).drop("_charge")


def frame_offsets(packs: DataFrame, pack: list[str], order: list[Column], blocks: str, frames_a_block: int = 375) -> DataFrame:
    """packs with frame_offset: the frames of the pack's audio before a row's; a pack has a bounded number of rows."""
    before = F.sum(F.col(blocks)).over(W.partitionBy(*pack).orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return packs.withColumn("frame_offset", F.coalesce(before * frames_a_block, F.lit(0)).cast("long"))


def layout(packs: DataFrame, pack: list[str], order: list[Column]) -> DataFrame:
    """One row for each token of packs (before, after, target: arrays of ids; audio: frames): its place in the pack and in its
    sequence, the sequence's number, id, label, whether it is an audio slot or frame, and whether the loss takes it.

    A pack has a bounded number of tokens, so windows over it do.
    """
    none = F.array().cast("array<int>")
    slots = F.array_repeat(F.lit(0), (F.col("audio") + 2).cast("int"))
    ids = F.concat(F.coalesce("before", none), slots, F.coalesce("after", none), F.coalesce("target", none))
    by_pack = W.partitionBy(*pack).orderBy(*order)
    rows = packs.withColumns({"_ids": ids, "seq": F.row_number().over(by_pack) - 1})
    rows = rows.withColumn("_start", F.coalesce(F.sum(F.size("_ids")).over(by_pack.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    kept = [c for c in packs.columns if c not in ("before", "after", "target", "audio")]
    sizes = {"_b": F.size(F.coalesce("before", none)), "_n": F.size("_ids"), "_t": F.size(F.coalesce("target", none))}
    tokens = rows.select(*kept, "seq", "_start", "audio", *(v.alias(k) for k, v in sizes.items()), F.posexplode("_ids").alias("pos", "id"))
    slot = (F.col("pos") >= F.col("_b")) & (F.col("pos") < F.col("_b") + F.col("audio") + 2)
    frame = (F.col("pos") > F.col("_b")) & (F.col("pos") < F.col("_b") + F.col("audio") + 1)
    label = F.when(F.col("pos") >= F.col("_n") - F.col("_t"), F.col("id")).otherwise(IGNORED_LABEL)
    out = tokens.select(*kept, "seq", (F.col("_start") + F.col("pos")).cast("long").alias("place"), "pos", "id", label.alias("label"), slot.alias("audio_slot"), frame.alias("audio_frame"))
    after = F.lead("label").over(W.partitionBy(*pack).orderBy("place"))
    return out.withColumn("supervised", F.coalesce(after != IGNORED_LABEL, F.lit(False)))


def layout_faults(tokens: DataFrame, pack: list[str], capacity: int, vocabulary: int) -> DataFrame:
    """Packs whose tokens break an invariant, and which."""
    each = tokens.groupBy(*pack).agg(
        F.count("*").alias("n"),
        F.max("place").alias("last"),
        F.countDistinct("place").alias("places"),
        F.count_if((F.col("id") < 0) | (F.col("id") >= vocabulary)).alias("outside"),
        F.count_if("supervised").alias("supervised"),
        F.count_if(F.col("pos") == 0).alias("begun"),
        F.countDistinct("seq").alias("sequences"),
    )
    rule = (
        F.when(F.col("n") > capacity, "too_long")
        .when((F.col("last") + 1 != F.col("n")) | (F.col("places") != F.col("n")), "places")
        .when(F.col("outside") > 0, "vocabulary")
        .when(F.col("begun") != F.col("sequences"), "positions")
        .when(F.col("supervised") == 0, "nothing_supervised")
    )
    return each.select(*pack, rule.alias("rule")).filter("rule is not null")


def uncommitted(packs: DataFrame, pack: list[str], key: str, committed: DataFrame) -> DataFrame:
    """The rows of packs none of whose keys is committed; a pack that is so in part, or a key in two packs, is an error."""
    done = committed.select(key).distinct().withColumn("_done", F.lit(True))
    rows = packs.join(done, key, "left")
    each = rows.groupBy(*pack).agg(F.count("*").alias("n"), F.count("_done").alias("done"))
    if bad := each.filter("done > 0 and done < n").head(1):
        raise ContractError(f"a pack is committed in part: {bad[0].asDict()}")
    if bad := packs.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").head(1):
        raise ContractError(f"{key} {bad[0][0]} is in several packs")
    return rows.filter("_done is null").drop("_done")

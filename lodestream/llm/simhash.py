"""SimHash near-duplicate groups by anchor points of a covering code.

A pair within the threshold lies, on one of three bit fields, within that field's share of it (pigeonhole). On each field the
words of a covering code are the anchors: every value is at home at the anchor that covers it, and visits every further anchor
within covering radius plus share, so each such pair meets where either one is at home. Only homes are compared with members.

* Fields of 23 bits use the perfect binary Golay code: 4,096 anchors, radius 3, share 1, 5.3 anchors a value.
* The field of 18 bits uses the code of all words: radius 0, share 0, one anchor a value.
* From FINE distinct fingerprints on, members meet only if one of five parts of the remaining bits agrees as well, which loses
  no pair: the remaining bits differ in at most four places.

Members of an anchor beyond TILE are compared in tiles, each a group of its own. A tile returns a forest of its links, never
its pairs, and components are found by star contraction over tables in the shared folder.

Defined results: null, empty or blank text has fingerprint zero, linked like any other; null doc_ids are kept but never name a
component (a component of nothing else has null); repeated rows each return a row; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, join_hot, store, text_blocks

SEED, SHINGLE, THRESHOLD = 42, 4, 4
#: Members of an anchor that meet in one group.
TILE = 1 << 15
#: Distinct fingerprints from which anchors are split by further bits.
FINE = 1 << 26
#: Anchors known to need tiles that are broadcast; more are joined.
BROADCAST_ROWS = 100_000
#: Links from which the joins of star steps split hubs.
HUBS_FROM = 1 << 20

_GENERATOR = 0b110001110101  # of the binary Golay code, degree 11
_RADIUS = 3

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_CHUNK = 1 << 16


def shingle_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, begin and end of each shingle in them, and its row."""
    solid = ~_BLANK[data]
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    begin = solid & ~before
    first = offsets[:-1][offsets[:-1] < len(data)]
    begin[first] |= solid[first]
    starts = np.flatnonzero(begin)
    words = np.cumsum(begin)[solid] - 1  # of each solid byte
    lengths = np.bincount(words, minlength=len(starts)).astype(np.int64)
    out = np.full(int(lengths.sum()) + len(starts), 32, np.uint8)
    out[np.arange(len(words)) + words] = _LOWER[data[solid]]
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    edges = np.searchsorted(starts, offsets)
    n = np.diff(edges)
    count = np.where(n > 0, np.maximum(1, n - SHINGLE + 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    word = np.repeat(edges[:-1], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return out.tobytes(), begins[word], ends[word + np.minimum(n[row], SHINGLE) - 1], row


def fingerprint_rows(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprints of the rows of a block."""
    raw, begins, ends, rows = shingle_bounds(data, offsets)
    raw = memoryview(raw)
    n = len(offsets) - 1
    ones, digest = np.zeros((n, 64), np.int64), xxhash.xxh64_intdigest
    for x in range(0, len(rows), _CHUNK):
        a, b, own = begins[x : x + _CHUNK].tolist(), ends[x : x + _CHUNK].tolist(), rows[x : x + _CHUNK]
        h = np.fromiter((digest(raw[i:j], SEED) for i, j in zip(a, b, strict=True)), "<u8", len(a))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    total = np.bincount(rows, minlength=n)
    return np.packbits(ones * 2 > total[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and text_hash of docs (doc_id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint_rows(data, offsets) for _, data, offsets in text_blocks(batch)]
            prints = np.concatenate(prints) if prints else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(rows, "doc_id long, fp long, text_hash long")


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of 12 low and 11 high bits; for each syndrome the patterns of weight up to radius + 1: begins, and patterns in order."""
    single = np.zeros(23, np.int64)
    for b in range(23):
        x = 1 << b
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= _GENERATOR << (k - 11)
        single[b] = x

    def of(values: np.ndarray, shift: int, bits: int) -> np.ndarray:
        out = np.zeros(len(values), np.int64)
        for b in range(bits):
            out ^= np.where(values >> b & 1, single[b + shift], 0)
        return out

    patterns = np.array([sum(1 << b for b in c) for w in range(_RADIUS + 2) for c in combinations(range(23), w)], np.int64)
    syndromes = of(patterns, 0, 23)
    order = np.lexsort((np.arange(len(patterns)), syndromes))
    return of(np.arange(4096), 0, 12), of(np.arange(2048), 12, 11), np.searchsorted(syndromes[order], np.arange(2049)), patterns[order]


def _parts(bits: int, n: int = 5) -> list[tuple[int, int]]:
    """n fields (shift, width) that share out so many bits."""
    edges = [bits * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def anchors(prints: np.ndarray, fine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of each print: index of the print, anchor, and whether it is at home there."""
    low, high, begins, patterns = _golay()
    index, anchor, home = [], [], []
    every = np.arange(len(prints))
    for field, (shift, width) in enumerate(((0, 23), (23, 23), (46, 18))):
        value = (prints >> np.uint64(shift) & np.uint64((1 << width) - 1)).astype(np.int64)
        if width == 23:
            syndrome = low[value & 4095] ^ high[value >> 12]
            n = begins[syndrome + 1] - begins[syndrome]
            i = np.repeat(every, n)
            pattern = patterns[np.repeat(begins[syndrome] - (np.cumsum(n) - n), n) + np.arange(len(i))]
            word, own = value[i] ^ pattern, np.bitwise_count(pattern) <= _RADIUS
        else:
            i, word, own = every, value, np.ones(len(prints), bool)
        word = word | field << 61
        if not fine:
            index.append(i), anchor.append(word), home.append(own)
            continue
        rest = (prints >> np.uint64(shift + width)) << np.uint64(shift) | prints & np.uint64((1 << shift) - 1) if shift + width < 64 else prints & np.uint64((1 << shift) - 1)
        for k, (a, b) in enumerate(_parts(64 - width)):
            part = (rest >> np.uint64(a) & np.uint64((1 << b) - 1)).astype(np.int64)
            index.append(i), anchor.append(word | k + 1 << 58 | part[i] << 24), home.append(own)
    return np.concatenate(index), np.concatenate(anchor), np.concatenate(home)


def _forest(members: np.ndarray, homes: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) of the members of one group that reach each other through links of a home."""
    label = np.arange(len(members))
    step = max(1, (1 << 20) // len(members))
    for x in range(0, len(homes), step):
        near = np.bitwise_count(members[homes[x : x + step], None] ^ members[None, :]) <= threshold
        for k in np.flatnonzero(near.sum(1) > 1):
            met = label[near[k]]
            least, most = met.min(), met.max()
            if least != most:
                to = np.arange(len(members))
                to[met] = least
                label = to[label]
    moved = np.flatnonzero(label != np.arange(len(members)))
    return members[moved], members[label[moved]]


def _links(distinct: DataFrame, threshold: int, fine: bool, tile: int) -> DataFrame:
    """Links a, b that join all prints of distinct (fp) as their pairs within the threshold do."""
    spark = distinct.sparkSession

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            for x in range(0, len(prints), 4096):
                index, anchor, home = anchors(prints[x : x + 4096].view(np.uint64), fine)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(home), pa.array(prints[x : x + 4096][index])], names=["anchor", "home", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]

        def groups(columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            change = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1
            edges = np.concatenate([[0], change, [len(columns[0])] if last else []]).astype(np.int64)
            at_home = np.concatenate([[0], np.cumsum(columns[2])])
            links = []
            for k in np.flatnonzero((np.diff(edges) > 1) & (np.diff(at_home[edges]) > 0)):
                a, b = edges[k], edges[k + 1]
                links.append(_forest(columns[3][a:b].view(np.uint64), np.flatnonzero(columns[2][a:b]), threshold))
            held[:] = [x[edges[-1] :] for x in columns]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in zip(*links, strict=True)], names=["a", "b"])

        for batch in batches:
            yield from groups([np.concatenate([h, x.to_numpy(zero_copy_only=False)]) for h, x in zip(held, batch.columns, strict=True)], False)
        if len(held[0]):
            yield from groups(list(held), True)

    members = distinct.mapInArrow(expand, "anchor long, home boolean, fp long")
    large = store(members.groupBy("anchor").count().filter(F.col("count") > tile).select("anchor", F.ceil(F.col("count") / tile).cast("int").alias("n")), "large-anchors")
    if (n_large := large.count()) == 0:
        members = members.select("anchor", F.lit(0).cast("long").alias("tile"), "home", "fp")
    else:
        # A member of part p of n is compared as a home with every part, and as a member with the homes of every part.
        members = members.join(F.broadcast(large) if n_large <= BROADCAST_ROWS else large, "anchor", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        part, other = F.pmod(F.xxhash64("fp"), F.col("n")), F.explode(F.sequence(F.lit(0), F.col("n") - 1))
        members = members.select("anchor", "home", "fp", "n", part.alias("part"), other.alias("other"))
        as_home = members.filter("home").select("anchor", (F.col("part") * F.col("n") + F.col("other")).alias("tile"), "home", "fp")
        as_member = members.filter("not home or part != other").select("anchor", (F.col("other") * F.col("n") + F.col("part")).alias("tile"), F.lit(False).alias("home"), "fp")
        members = as_home.union(as_member)
    found = members.repartition("anchor", "tile").sortWithinPartitions("anchor", "tile").mapInArrow(compare, "a long, b long")
    return store(found.distinct(), "links")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (the least node that it reaches) of links, by alternating large-star and small-star steps.

    Each step groups with partial aggregates and joins on the node; the links stay in tables of the shared folder.
    """

    def joined(rows: DataFrame, least: DataFrame, split: bool) -> DataFrame:
        return join_hot(rows, store(least, "least"), "u") if split else rows.join(least.drop("n"), "u")

    edges = store(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct(), "edges")
    before, n = None, edges.count()
    while True:
        # Large star: neighbours above a node move to the least of its neighbours and itself.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        edges = joined(both.filter("v > u"), least, n >= HUBS_FROM).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: neighbours below a node, and itself, move to the least of them.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))  # few, as links go from a node to the least of its neighbours
        moved = edges.join(least, "u")
        edges = store(moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        n = now[0]
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _components(prints: DataFrame, least: Column, threshold: int, tile: int, fine_from: int) -> DataFrame:
    """A table of fp, chosen (the least of an expression over the rows of prints that are reached) and n (rows) of all distinct prints."""
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"the anchors cover up to {THRESHOLD} differing bits")
    distinct = store(prints.groupBy("fp").agg(F.min(least).alias("least"), F.count("*").alias("n")), "distinct")
    links = _links(distinct.select("fp"), threshold, distinct.count() >= fine_from, tile)
    roots = components(links)
    roots = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    linked = store(distinct.join(roots, distinct["fp"] == roots["node"]).select("fp", "root", "least"), "linked")
    names = linked.groupBy("root").agg(F.min("least").alias("chosen"), F.count("*").alias("n"))
    linked = join_hot(linked, names, "root").select("fp", "chosen")
    return store(distinct.join(linked, "fp", "left").select("fp", F.coalesce("chosen", "least").alias("chosen"), "n"), "named")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, tile: int = TILE, fine_from: int = FINE) -> DataFrame:
    """Per document of docs (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (least doc_id that it reaches)."""
    prints = store(fingerprints(docs), "fingerprints")
    named = _components(prints, F.col("doc_id"), threshold, tile, fine_from)
    return join_hot(prints, named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("chosen").alias("component_id"))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD, tile: int = TILE, fine_from: int = FINE) -> DataFrame:
    """The rows of docs, all columns, that stay when one of each component does: the one of the least doc_id, then hash of text."""
    prints = store(fingerprints(docs), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    chosen = _components(prints, row, threshold, tile, fine_from)
    # Without nulls the join and the last step share one exchange of the texts.
    names = free_names(docs, "kept_named", "kept_id", "kept_hash")

    def key(text_hash: Column) -> list[Column]:
        named = [F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")), text_hash]
        return [x.alias(name) for x, name in zip(named, names, strict=True)]

    kept = store(chosen.select("chosen.*").select(*key(F.col("text_hash"))).distinct(), "kept")
    keyed = docs.select("*", *key(F.xxhash64(F.col("text").cast("string"))))
    return keyed.join(kept, names, "left_semi").dropDuplicates(names).drop(*names)

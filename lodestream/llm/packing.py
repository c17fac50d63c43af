"""Packing along a space-filling curve: neighbouring documents share sequences.

A document's words are hashed to a vector, the vector is projected to a few fixed dimensions, and the Hilbert index of that
point orders the documents. Range partitions of that order are packed each by itself: ids are laid end to end and cut at
every multiple of the capacity, so only the tail of a partition leaves a sequence unfilled; it is cut into powers of two.

The bounds of the ranges come from a sample of rows, weighed by their bytes; every row's key is computed once, in the pass that
gives it its range. The lowest bits of a key are of a hash of doc_id, text and the row's place among its equals in a batch, so that
copies and repeated rows, which share a point, spread over ranges.

Defined results: null text counts as empty (the end id alone); null or repeated doc_ids are packed like any others; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import cuts, encoder, fingerprints, with_end
from .common import text_blocks

HASHED, DIMENSIONS, BITS = 256, 3, 16
#: Projected values beyond this many standard deviations share the outermost cells.
SPAN = 3.0
#: Bits of a key below the curve's, which tell equal points apart.
SALT_BITS = 63 - DIMENSIONS * BITS
#: Sampled rows for a bound between ranges, and in all; and bytes of text that a range takes at most, about.
SAMPLED, MOST_SAMPLED, RANGE_BYTES = 100, 1_000_000, 1 << 28


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indices of points (rows) with coordinates of so many bits."""
    x = points.astype(np.uint64).T.copy()
    dims, one = len(x), np.uint64(1)
    # Undo the excess rotations from the coarsest bit down, then Gray-code.
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        low = q - one
        for i in range(dims):
            up = (x[i] & q) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low).astype(np.uint64)
            x[0] ^= np.where(up, low, swap).astype(np.uint64)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        t ^= np.where((x[-1] & q) != 0, q - one, 0).astype(np.uint64)
    x ^= t
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << one | (x[i] >> np.uint64(b) & one)
    return out.astype(np.int64)


def curve_keys(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hilbert keys of the rows of a block."""
    starts = cuts(data, offsets)
    hashes = fingerprints(data, starts, np.append(starts[1:], len(data)))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    signs = np.where(hashes >> np.uint64(63), 1.0, -1.0)
    n = len(offsets) - 1
    vectors = np.bincount(rows * HASHED + (hashes % np.uint64(HASHED)).astype(np.int64), signs, n * HASHED).reshape(n, HASHED)
    vectors = np.sign(vectors) * np.sqrt(np.abs(vectors))
    vectors /= np.maximum(np.sqrt((vectors * vectors).sum(1, keepdims=True)), 1e-12)
    flat = np.round(vectors @ np.random.default_rng(7).standard_normal((HASHED, DIMENSIONS)), 9)
    cells = np.clip((flat / SPAN + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
    return hilbert(cells.astype(np.int64), BITS)


_PIECES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """Pieces of docs (doc_id, text) in sequences of at most capacity ids: doc_id, start (the document's ids before the piece),
    length, ids_crc32 (of 32-bit little-endian ids), doc_tokens, sequence_id, offset (in the sequence).

    A document's ids are the tokenizer's, then end_id. Every sequence is full but for powers of two at a partition's end.
    """

    def keys_of(batch: pa.RecordBatch) -> np.ndarray:
        keys = [curve_keys(data, offsets) for _, data, offsets in text_blocks(batch)]
        return np.concatenate(keys) << SALT_BITS | _salts(batch.column(2).to_numpy(zero_copy_only=False)) if keys else np.zeros(0, np.int64)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.add(pc.fill_null(pc.binary_length(batch.column(1)), 0), 1).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(batch)), sizes], names=["key", "size"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(batch)
            ranges = np.searchsorted(bounds, keys, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys), pa.array(ranges)], names=["doc_id", "text", "key", "range"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first, filled = encoder(tokenizer_path), TaskContext.get().partitionId() << 40, 0
        tail: list[tuple] = []  # pieces of the unfilled sequence, with their ids
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, data, offsets in text_blocks(batch):
                ids, counts = with_end(*own.encode(data, offsets), end_id)
                stops = np.cumsum(counts)
                begin, end = filled + stops - counts, filled + stops
                pieces = (end - 1) // capacity - begin // capacity + 1
                of = np.repeat(np.arange(len(counts)), pieces)
                sequence = begin[of] // capacity + np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                a, b = np.maximum(begin[of], sequence * capacity), np.minimum(end[of], (sequence + 1) * capacity)
                raw = memoryview(ids.astype("<u4").tobytes())
                filled, before = int(end[-1]), filled
                whole = int(np.searchsorted(sequence, filled // capacity))
                out = [tail.pop(0)[:7] for _ in range(len(tail))] if whole else []
                rows = zip(of.tolist(), a.tolist(), b.tolist(), sequence.tolist(), begin[of].tolist(), counts[of].tolist(), strict=True)
                for k, (i, x, y, s, g, n) in enumerate(rows):
                    part = raw[4 * (x - before) : 4 * (y - before)]
                    piece = (names[row + i], x - g, y - x, zlib.crc32(part), n, first + s, x - s * capacity)
                    if k < whole:
                        out.append(piece)
                    else:
                        tail.append((*piece, bytes(part)))
                if out:
                    yield _batch(out)
        if tail:
            yield _batch(list(_powers_of_two(tail, filled % capacity)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("salt", F.xxhash64("doc_id", "text"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, min(SAMPLED * ranges, MOST_SAMPLED) / max(1, rows.count()))
    sample = rows.sample(share, 17).mapInArrow(sampled, "key long, size long").toArrow()  # about MOST_SAMPLED pairs of numbers at most
    sizes = sample.column("size").to_numpy()
    ranges = max(ranges, int(sizes.sum() / share) // RANGE_BYTES)
    bounds = _bounds(sample.column("key").to_numpy(), sizes, ranges)
    dealt = rows.mapInArrow(keyed, "doc_id long, text string, key long, range int").repartitionById(ranges, "range")
    return dealt.sortWithinPartitions("key", "doc_id").select("doc_id", "text").mapInArrow(packed, ", ".join(f"{x} long" for x in _PIECES))


def _salts(hashes: np.ndarray) -> np.ndarray:
    """SALT_BITS of each hash and its place among those equal to it."""
    _, codes, n = np.unique(hashes, return_inverse=True, return_counts=True)
    order = np.argsort(codes, kind="stable")
    place = np.empty(len(hashes), np.uint64)
    place[order] = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):
        mixed = hashes.astype(np.int64).view(np.uint64) + place * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - SALT_BITS)).astype(np.int64)


def _bounds(keys: np.ndarray, sizes: np.ndarray, ranges: int) -> np.ndarray:
    """Keys between so many ranges of about equal size."""
    order = np.argsort(keys)
    below = np.cumsum(sizes[order])
    if not len(below):
        return np.zeros(0, np.int64)
    return keys[order][np.minimum(np.searchsorted(below, below[-1] * np.arange(1, ranges) / ranges), len(below) - 1)]


def _powers_of_two(tail: list[tuple], length: int) -> Iterator[tuple]:
    """Cuts the pieces of one unfilled sequence of that length into sequences whose lengths are powers of two."""
    edges, at = [], 0
    for b in range(length.bit_length() - 1, -1, -1):
        if length >> b & 1:
            edges.append((at, at + (1 << b)))
            at += 1 << b
    for name, start, n, _, total, sequence, offset, raw in tail:
        for k, (a, b) in enumerate(edges):
            x, y = max(a, offset), min(b, offset + n)
            if x < y:
                yield name, start + x - offset, y - x, zlib.crc32(raw[4 * (x - offset) : 4 * (y - offset)]), total, sequence + k, x - a


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=_PIECES)

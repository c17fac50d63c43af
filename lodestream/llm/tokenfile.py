"""Token-id files with Elias-Fano coded document boundaries.

A file image holds consecutive documents: their ids, one after the other in the narrowest unsigned width, and the boundaries
as an Elias-Fano sequence, whose select structure returns any offset without a table of 64-bit offsets. Spark's own writers
store the images as binary rows, so any file system it knows will do and a retried task leaves one copy.

Defined results: null text counts as empty (the end id alone); null doc_ids come first; repeated doc_ids are kept, ordered by
a hash of their text; an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder, with_end
from .common import store, text_blocks

_BLOCK = 512


class EliasFano:
    """A non-decreasing sequence of integers in about 2 + log2(last / n) bits each."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        padded = np.zeros(-(-max(1, len(high) * 8) // _BLOCK) * _BLOCK // 8, np.uint8)
        padded[: len(high)] = high
        self._blocks = padded.reshape(-1, _BLOCK // 8)
        #: Ones before each block of the high bits.
        self._ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self._blocks).sum(1, dtype=np.uint32), dtype=np.uint32)])

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (last // max(1, n)).bit_length() - 1)
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits((values[:, None] >> shifts & np.uint64(1)).astype(np.uint8).reshape(-1), bitorder="little")
        at = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        bits[at] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"))

    def select(self, index: np.ndarray) -> np.ndarray:
        """The values at index."""
        index = np.asarray(index, np.int64)
        out = np.empty(len(index), np.int64)
        for x in range(0, len(index), 4096):
            i = index[x : x + 4096]
            block = np.searchsorted(self._ranks, i, side="right") - 1
            ones = np.cumsum(np.unpackbits(self._blocks[block], axis=1, bitorder="little"), axis=1, dtype=np.int32)
            place = (ones <= (i - self._ranks[block])[:, None]).sum(1)
            out[x : x + 4096] = (block * _BLOCK + place - i) << self.low_bits
        if self.low_bits:
            bits = index[:, None] * self.low_bits + np.arange(self.low_bits)
            out |= (((self.low[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(1)
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, low_bits, a, b = struct.unpack_from("<QBQQ", data, at)
        at += struct.calcsize("<QBQQ")
        low, high = np.frombuffer(data, np.uint8, a, at), np.frombuffer(data, np.uint8, b, at + a)
        return cls(n, low_bits, low, high), at + a + b


_MAGIC = b"TOKEF001"


def write_image(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A file image of consecutive documents."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    valid = np.packbits(np.array([x is not None for x in doc_ids], np.uint8), bitorder="little")
    names = np.array([x or 0 for x in doc_ids], "<i8")
    bounds = EliasFano.of(np.concatenate([[0], np.cumsum(counts)]))
    return _MAGIC + struct.pack("<QQB", len(doc_ids), len(ids), width) + bounds.to_bytes() + valid.tobytes() + names.tobytes() + ids.astype(f"<u{width}").tobytes()


class Image:
    """Reads a file image; any document's ids are found by two selects."""

    def __init__(self, data: bytes):
        if data[:8] != _MAGIC:
            raise ValueError("not a token file")
        self.n_docs, self.n_ids, width = struct.unpack_from("<QQB", data, 8)
        self.bounds, at = EliasFano.from_bytes(data, 8 + struct.calcsize("<QQB"))
        valid = np.unpackbits(np.frombuffer(data, np.uint8, (self.n_docs + 7) // 8, at), bitorder="little")[: self.n_docs]
        at += (self.n_docs + 7) // 8
        names = np.frombuffer(data, "<i8", self.n_docs, at)
        self.doc_ids = [int(x) if v else None for x, v in zip(names, valid, strict=True)]
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at + 8 * self.n_docs)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds.select(np.array([i, i + 1]))
        return self.ids[a:b]


_FILES = "part long, segment long, n_docs long, n_ids long, part_start long, content binary"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, segment_ids: int = 1 << 16) -> DataFrame:
    """Writes the ids of docs (doc_id, text), each document's followed by end_id, in ascending doc_id order.

    Returns the stored files, one a row: part and segment give their order, part_start the ids before it in its part.
    An image takes whole documents until segment_ids; a longer document has one of its own.
    """

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, segment, before = encoder(tokenizer_path), 0, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, data, offsets in text_blocks(batch):
                ids, counts = with_end(*own.encode(data, offsets), end_id)
                stops = np.concatenate([[0], np.cumsum(counts)])
                groups = stops[:-1] // segment_ids
                edges = [0, *(np.flatnonzero(np.diff(groups)) + 1), len(counts)]
                out = []
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    content = write_image(names[row + a : row + b], ids[stops[a] : stops[b]], counts[a:b])
                    out.append((part, segment, int(b - a), int(stops[b] - stops[a]), before + int(stops[a]), content))
                    segment += 1
                before += int(stops[-1])
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 5 else pa.int64()) for k, x in enumerate(zip(*out, strict=True))], names=["part", "segment", "n_docs", "n_ids", "part_start", "content"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ("doc_id", F.xxhash64("text"))
    return store(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(images, _FILES), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of stored files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, ids (binary, as stored 32-bit)."""
    # One number for each part, of which there are as many as tasks that wrote files.
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    before, bases = 0, {}
    for part, n in sorted((r["part"], r["n"]) for r in totals):
        bases[part] = before
        before += n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, content in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                image = Image(content)
                bounds = image.bounds.select(np.arange(image.n_docs + 1))
                raw = memoryview(image.ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(image.doc_ids, pa.int64()), pa.array(bounds[:-1] + (bases[part] + start)), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.select("part", "part_start", "content").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")

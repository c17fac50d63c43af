"""SentencePiece vocabularies as unigram models: encoding, decoding and counting.

A word (a run of white-space marks and what follows it) has the segmentation whose piece scores sum to most; sums are 32-bit
floats taken from left to right, of equal sums the longest last piece wins, and a character without a piece costs ten more than
the least score and becomes the pieces of its bytes. This is what the library's unigram model does with such a vocabulary,
one word at a time; vocabularies with a piece that runs on into the next word's mark are refused.

The installed vocabulary file was built for merges (byte-pair encoding), whose segmentation is no Viterbi path. It is read here as
the unigram table that its pieces and scores are, so its ids differ from the library's on the file as it stands.

* Pieces (encoding): words of equal length advance together; hashes of their substrings probe the sorted keys of the pieces, and
  vectorised maxima store backpointers.
* Counts: an Aho-Corasick automaton enumerates the pieces in a word; the best score and its piece count are all that is kept.

Defined results: null text counts as empty and has no piece; a literal white-space mark decodes as a space, all else comes back
as it was; null or repeated doc_ids return a row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PartEncoder
from .common import text_blocks

MARK = "▁"
_MARK_BYTES = MARK.encode()
_NORMAL, _BYTE = 1, 6
#: Added to the least score for a character without a piece; fixed by the format.
UNKNOWN_PENALTY = 10.0
#: Words of more characters advance alone.
_LONG = 192
#: Characters of words that advance together.
_TOGETHER = 1 << 17


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, data[at : at + size]
            at += size


class Vocabulary:
    """Pieces and scores of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            fields = list(proto_fields(file.read()))
        rows = [dict(proto_fields(v)) for f, v in fields if f == 1]
        normaliser = dict(proto_fields(next((v for f, v in fields if f == 3), b"")))
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1):
            raise ValueError("only vocabularies with a dummy prefix, marks for spaces and no other normalisation are read")
        self.pieces = [r[1].decode() for r in rows]
        self.scores = np.array([struct.unpack("<f", r[2])[0] if 2 in r else 0.0 for r in rows], np.float32)
        kinds = [r.get(3, 1) for r in rows]
        self.normal = [k for k, x in enumerate(kinds) if x == _NORMAL]
        self.byte_ids = np.array([k for k, x in enumerate(kinds) if x == _BYTE], np.int64)
        if len(self.byte_ids) != 256:
            raise ValueError("only vocabularies with a piece for every byte are read")
        if any(MARK in self.pieces[k].lstrip(MARK) for k in self.normal):
            raise ValueError("a piece runs on into another word")
        #: Sums of whole scores are exact until they take 24 bits; others are rounded each time.
        self.whole_until = np.float64(1 << 24) if (self.scores == np.round(self.scores)).all() else 0.0
        self.unknown = np.float32(self.scores[self.normal].min() - np.float32(UNKNOWN_PENALTY))
        surface = [b"" if x not in (_NORMAL, _BYTE) else bytes([k - self.byte_ids[0]]) if x == _BYTE else p.replace(MARK, " ").encode() for k, (p, x) in enumerate(zip(self.pieces, kinds, strict=True))]
        self.lengths = np.array([len(x) for x in surface], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.surface = np.frombuffer(b"".join(surface), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, without the space put before it."""
        n = self.lengths[ids]
        stops = np.cumsum(n)
        raw = self.surface[np.repeat(self.begins[ids] - (stops - n), n) + np.arange(int(n.sum()))].tobytes()
        return raw[1:] if raw[:1] == b" " else raw


class _Words(PartEncoder):
    """Cuts text into words; every row begins with a mark, written as a space."""

    at_once = 1 << 16

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if (data == _MARK_BYTES[0]).any() and _MARK_BYTES in (raw := data.tobytes()):
            rows = [raw[a:b].replace(_MARK_BYTES, b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
        full = np.diff(offsets) > 0
        shift = np.concatenate([[0], np.cumsum(full)])
        out = np.full(len(data) + int(shift[-1]), 32, np.uint8)
        out[np.arange(len(data)) + np.repeat(shift[1:], np.diff(offsets))] = data
        begin = out == 32
        begin[1:] &= out[:-1] != 32
        offsets = offsets + shift
        begin[offsets[:-1][full]] = True
        return out, offsets, np.flatnonzero(begin)


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _points(words: list[str]) -> np.ndarray:
    """Code points of words of equal length, a row each, their spaces as marks."""
    return np.frombuffer("".join(words).replace(" ", MARK).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(words), -1)


class PieceEncoder(_Words):
    def __init__(self, path: str):
        super().__init__()
        self.vocabulary = v = Vocabulary(path)
        by_length: dict[int, list[int]] = {}
        for k in v.normal:
            by_length.setdefault(len(v.pieces[k]), []).append(k)
        self.longest = max(by_length)
        with np.errstate(over="ignore"):
            self.powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(self.longest, _BASE))])
            keys, own = [], []
            for n, ks in by_length.items():
                keys.append(self._mixed(self._prefixes(_points([v.pieces[k] for k in ks]))[n], np.uint64(n)))
                own.append(ks)
        keys, own = np.concatenate(keys), np.concatenate(own)
        order = np.argsort(keys)
        self.piece_keys, self.piece_ids = keys[order], own[order]
        if (np.diff(self.piece_keys) == 0).any():
            raise ValueError("two pieces have one key")
        #: Leading bits of the keys, which most substrings that are no piece fail.
        self.leading = np.zeros(1 << 20, bool)
        self.leading[self.piece_keys >> np.uint64(44)] = True

    @staticmethod
    def _prefixes(points: np.ndarray) -> np.ndarray:
        """Hashes of the prefixes of words (rows of points), by length and then word; 0 for the empty one."""
        out = np.zeros((points.shape[1] + 1, len(points)), np.uint64)
        with np.errstate(over="ignore"):
            x = points.T.astype(np.uint64) + np.uint64(1)
            x = (x ^ x << np.uint64(21)) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            for k in range(len(x)):
                out[k + 1] = out[k] * _BASE + x[k]
        return out

    @staticmethod
    def _mixed(h: np.ndarray, n: np.ndarray | np.uint64) -> np.ndarray:
        return (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) + n

    def _probe(self, ends: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the substrings of these sizes between these prefixes are pieces (places in the flat array), and their ids."""
        with np.errstate(over="ignore"):
            keys = self._mixed(ends - starts * self.powers[sizes], sizes.astype(np.uint64)).reshape(-1)
        hit = np.flatnonzero(self.leading[keys >> np.uint64(44)])
        keys = keys[hit]
        place = np.minimum(np.searchsorted(self.piece_keys, keys), len(self.piece_keys) - 1)
        true = self.piece_keys[place] == keys
        return hit[true], self.piece_ids[place[true]]

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        by_length: dict[int, list[int]] = {}
        for k, word in enumerate(parts):
            by_length.setdefault(len(word), []).append(k)
        each: list = [None] * len(parts)
        for n, ks in by_length.items():
            step = max(1, _TOGETHER // n)
            for x in range(0, len(ks), step):
                own = ks[x : x + step]
                points = _points([parts[k] for k in own])
                if n > _LONG:
                    found = [self._alone(row) for row in points]
                else:
                    found = self._together(points)
                for k, ids in zip(own, found, strict=True):
                    each[k] = ids
        counts = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter((i for x in each for i in x), np.uint32, int(counts.sum())), counts

    def _together(self, points: np.ndarray) -> list[list[int]]:
        """Ids of words of equal length."""
        rows, n = points.shape
        prefixes, scores, unknown = self._prefixes(points), self.vocabulary.scores, self.vocabulary.unknown
        best = np.zeros((n + 1, rows), np.float32)
        last, size = np.zeros((n + 1, rows), np.int32), np.zeros((n + 1, rows), np.int32)
        every = np.arange(rows)
        for end in range(1, n + 1):
            low = max(0, end - self.longest)  # the longest first, as a maximum takes the first of equals
            value, piece = np.full((end - low, rows), -np.inf, np.float32), np.full((end - low, rows), -1, np.int32)
            value[-1] = best[end - 1] + unknown
            there, ids = self._probe(prefixes[end], prefixes[low:end], np.arange(end - low, 0, -1)[:, None])
            piece.reshape(-1)[there] = ids
            value.reshape(-1)[there] = best[low:end].reshape(-1)[there] + scores[ids]
            pick = value.argmax(0)
            best[end], last[end], size[end] = value[pick, every], piece[pick, every], end - low - pick
        out: list[list[int]] = [[] for _ in range(rows)]
        at, live = np.full(rows, n), every
        while len(live):
            ids, m = last[at[live], live], size[at[live], live]
            for i, piece, x in zip(live.tolist(), ids.tolist(), at[live].tolist(), strict=True):
                out[i].extend((piece,) if piece >= 0 else self._bytes(points[i, x - 1]))
            at[live] -= m
            live = live[at[live] > 0]
        return [x[::-1] for x in out]

    def _bytes(self, point: int) -> list[int]:
        """Ids of a character's bytes, from the last."""
        return [int(self.vocabulary.byte_ids[b]) for b in reversed(chr(point).encode())]

    def _alone(self, points: np.ndarray) -> list[int]:
        """Ids of one long word: all probes at once, then a pass over its places."""
        n, prefixes = len(points), self._prefixes(points[None, :])[:, 0]
        found: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for m in range(min(n, self.longest), 0, -1):
            for s, piece in zip(*(x.tolist() for x in self._probe(prefixes[m:], prefixes[: n - m + 1], np.array([m]))), strict=True):
                found[s + m].append((m, piece))
        best, last, scores = np.zeros(n + 1, np.float32), [(0, -1)] * (n + 1), self.vocabulary.scores
        for end in range(1, n + 1):
            top, pick = None, (1, -1)
            for m, piece in found[end]:
                if top is None or best[end - m] + scores[piece] > top:
                    top, pick = best[end - m] + scores[piece], (m, piece)
            if (not found[end] or found[end][-1][0] != 1) and (top is None or best[end - 1] + self.vocabulary.unknown > top):
                top, pick = best[end - 1] + self.vocabulary.unknown, (1, -1)
            best[end], last[end] = top, pick
        out, end = [], n
        while end:
            m, piece = last[end]
            out.extend((piece,) if piece >= 0 else self._bytes(points[end - 1]))
            end -= m
        return out[::-1]


class PieceCounter(_Words):
    """Counts of pieces; a part's one id is its count."""

    def __init__(self, path: str):
        import ahocorasick

        super().__init__()
        self.vocabulary = v = Vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for k in v.normal:
            self.automaton.add_word(v.pieces[k], (len(v.pieces[k]), float(v.scores[k])))
        self.automaton.make_automaton()

    def _count(self, word: str) -> int:
        n, unknown, whole = len(word), float(self.vocabulary.unknown), -float(self.vocabulary.whole_until)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(word):  # at each end from the longest to the shortest
            found[end + 1].append(match)
        for end in range(1, n + 1):
            top, own, single = None, 0, False
            for m, score in found[end]:
                value = best[end - m] + score
                if value <= whole or value > 0:
                    value = float(np.float32(value))
                if top is None or value > top:
                    top, own = value, count[end - m] + 1
                single = m == 1
            if not single:
                value = float(np.float32(best[end - 1] + unknown))
                if top is None or value > top:
                    top, own = value, count[end - 1] + len(word[end - 1].encode())
            best[end], count[end] = top, own
        return count[n]

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.fromiter((self._count(x.replace(" ", MARK)) for x in parts), np.uint32, len(parts)), np.ones(len(parts), np.int64)


@lru_cache(maxsize=2)
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per document of docs (doc_id, text): doc_id, n_pieces, ids (binary, 32-bit little-endian), text_sha256."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_encoder(path)
        for batch in batches:
            for row, data, offsets in text_blocks(batch):
                ids, counts = own.encode(data, offsets)
                stops, raw = np.cumsum(counts), ids.astype("<u4").tobytes()
                each = [raw[4 * (b - n) : 4 * b] for b, n in zip(stops.tolist(), counts.tolist(), strict=True)]
                digests = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(counts)), pa.array(counts), pa.array(each, pa.binary()), pa.array(digests)], names=["doc_id", "n_pieces", "ids", "text_sha256"])

    return _texts(docs).mapInArrow(rows, "doc_id long, n_pieces long, ids binary, text_sha256 string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of encoded (doc_id, ids): doc_id, n_pieces, ids_crc32, text, and the columns that encode() adds."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _vocabulary(path)
        for batch in batches:
            for x in range(0, batch.num_rows, 256):
                part = batch.slice(x, 256)
                ids = [m or b"" for m in part.column(1).to_pylist()]
                texts = [own.decode(np.frombuffer(m, "<u4").astype(np.int64)).decode() for m in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(m) // 4 for m in ids]), pa.array([zlib.crc32(m) for m in ids], pa.int64()), pa.array(texts, pa.string()), part.column(2)], names=["doc_id", "n_pieces", "ids_crc32", "text", "text_sha256"])

    return encoded.select("doc_id", "ids", "text_sha256").mapInArrow(rows, "doc_id long, n_pieces long, ids_crc32 long, text string, text_sha256 string")


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Per document of docs (doc_id, text): doc_id, n_tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = piece_counter(path)
        for batch in batches:
            for row, data, offsets in text_blocks(batch):
                each, words = own.encode(data, offsets)
                sums = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
                stops = np.concatenate([[0], np.cumsum(words)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(words)), pa.array(np.diff(sums[stops]))], names=["doc_id", "n_tokens"])

    return _texts(docs).mapInArrow(rows, "doc_id long, n_tokens long")

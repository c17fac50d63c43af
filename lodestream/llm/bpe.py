"""Byte-level BPE ids of whole texts by the tokenizers library, each distinct word encoded once for many texts.

Text is cut where the tokenizer's own pattern always ends a word, so that the ids of the parts, joined, are those of the
whole. Parts met before are found in a hash table, compared byte by byte; the library encodes the others. The table has a fixed
size: when it is full, the parts that were not met for longest make room.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes of the longest part that is kept, in words of eight; longer parts are encoded each time they occur.
_WORDS = 4
LONGEST_KEPT = 8 * _WORDS
#: Parts kept by one Python worker, and slots of the table that finds them.
MOST_KEPT = 3 << 18
_SLOT_BITS = 21
#: Parts that are looked up at once.
_LOOKED_UP = 1 << 17
_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2**64."""
    inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, x))]) for x in (_ODD, inverse))


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
    """64-bit fingerprints of the slices [start, end) of data, equal for equal slices; values are those of data's items, bytes if not given."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverses = _powers(1 << max(20, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((_byte_values() if values is None else values)[data] * powers[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverses[starts]
        h ^= h >> np.uint64(29)
        h = h * np.uint64(0xBF58476D1CE4E5B9) + (ends - starts).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


#: Classes of bytes, a bit each: white space, letter, solid (neither white space nor control character), ASCII but no letter, white
#: space that is no space, first byte of a character of two bytes, further byte, and the first byte of U+00C0 to U+00FF.
_SPACE, _LETTER, _SOLID, _OTHER, _BREAK, _LEAD, _TAIL, _LATIN = (1 << k for k in range(8))


def classes(but: bytes = b"") -> np.ndarray:
    """The classes of each byte; those given don't count as ASCII but no letter."""
    out = np.zeros(256, np.uint8)
    out[[9, 10, 11, 12, 13, 32]] |= _SPACE
    out[9:14] |= _BREAK
    out[33:127] |= _SOLID
    out[:128] |= _OTHER
    letters = [*range(65, 91), *range(97, 123)]
    out[letters] = _SOLID | _LETTER
    out[list(but)] &= ~np.uint8(_OTHER)
    out[0xC3:0xE0] |= _LEAD
    out[0xC3] |= _LATIN
    out[0x80:0xC0] |= _TAIL
    out[[0x97, 0xB7]] = 0  # after 0xC3 the signs of multiplication and division
    return out


_CLASSES = classes()


def cuts(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = _CLASSES) -> np.ndarray:
    """Ascending positions where parts begin: row starts, ASCII white space after a solid character, ASCII that is no letter after a
    Latin letter, and solid ASCII after one white space that is no space, itself after a solid character or at the block's start.

    No match of the pre-tokenizer's pattern crosses such a position, and none looks behind it.
    """
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n > 1:
        here = kinds[data]
        last, here = here[:-1].copy(), here[1:]
        if n > 2:
            # A character of two bytes is solid, as no white space has such a first byte, and may be a Latin letter.
            tail, first = last[1:] & np.uint8(_TAIL), last[:-1].copy()
            last[1:] |= (tail >> 1 & first & _LEAD) >> 3 | (tail << 1 & first & _LATIN) >> 6
        after_break = here >> 2 & last >> 4
        after_break[1:] &= last[:-1] >> 2  # of more white space the pattern's look ahead leaves the last character alone
        cut[1:-1] = (here & last >> 2 | here >> 3 & last >> 1 | after_break) & 1
    cut[offsets[offsets < n]] = True
    cut[n] = False
    return np.flatnonzero(cut)


_MIX = np.random.default_rng(44).integers(1, 1 << 63, _WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one integer; zeros follow data."""
    out = np.concatenate([data, np.zeros(LONGEST_KEPT + 8, np.uint8)])
    for kind, n in (("<u2", 1), ("<u4", 2), ("<u8", 4)):
        wide = out.astype(kind)
        out = wide[:-n] | wide[n:] << np.array(8 * n, kind)
    return out


class PartEncoder:
    """Ids of texts as one array, with counts, from the ids of parts that are kept."""

    #: Parts that are encoded at once.
    at_once = 4096

    def __init__(self):
        self.table = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.words, self.sizes = np.zeros((_WORDS, MOST_KEPT), np.uint64), np.zeros(MOST_KEPT, np.uint8)
        self.begins, self.counts, self.met = (np.zeros(MOST_KEPT, np.int32) for _ in range(3))
        self.ids = np.zeros(1 << 16, np.uint32)
        self.n_parts = self.n_ids = self.now = 0

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes to encode, their row offsets, and where parts begin: at every row's start among others."""
        raise NotImplementedError

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, one after the other, and the count of each."""
        raise NotImplementedError

    @staticmethod
    def _hashes(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = words[0] * _MIX[0] + sizes.astype(np.uint64)
            for k in range(1, _WORDS):
                own = np.flatnonzero(sizes > 8 * k)
                h[own] = (h[own] ^ h[own] >> np.uint64(31)) * _MIX[k] + words[k, own]
            return (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)

    @staticmethod
    def _slots(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    @staticmethod
    def _same(words: np.ndarray, sizes: np.ndarray, at: np.ndarray, others: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether the parts at some places are the others, byte by byte."""
        out = (sizes[at] == lengths) & (words[0][at] == others[0])
        for k in range(1, _WORDS):
            own = np.flatnonzero(out & (lengths > 8 * k))
            out[own] = words[k][at[own]] == others[k][own]
        return out

    def _find(self, slots: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Indices of parts in what is kept; -1 for those that aren't."""
        out, live = np.full(len(slots), -1, np.int64), np.arange(len(slots))
        while len(live):
            at = self.table[slots].astype(np.int64)
            taken = at >= 0
            if not taken.all():
                live, at, slots, words, sizes = live[taken], at[taken], slots[taken], words[:, taken], sizes[taken]
            same = self._same(self.words, self.sizes, at, words, sizes)
            out[live[same]] = at[same]
            live, slots, words, sizes = live[~same], slots[~same] + 1 & (1 << _SLOT_BITS) - 1, words[:, ~same], sizes[~same]
        return out

    def _enter(self, first: int, n: int) -> None:
        """Puts the kept parts of first and the n - 1 after it into the table."""
        live = np.arange(first, first + n)
        slots = self._slots(self._hashes(self.words[:, live], self.sizes[live].astype(np.int64)))
        while len(live):
            free = self.table[slots] < 0
            self.table[slots[free]] = live[free]
            lost = self.table[slots] != live
            live, slots = live[lost], slots[lost] + 1 & (1 << _SLOT_BITS) - 1

    def _make_room(self) -> None:
        """Lets go of the half of the parts that was met longest ago."""
        keep = np.sort(np.argsort(self.met[: self.n_parts], kind="stable")[-(MOST_KEPT // 2) :])
        counts = self.counts[keep].astype(np.int64)
        stops = np.cumsum(counts)
        ids = self.ids[np.repeat(self.begins[keep] - (stops - counts), counts) + np.arange(int(stops[-1]))]
        for x in (*self.words, self.sizes, self.met, self.counts):
            x[: len(keep)] = x[keep]
        self.begins[: len(keep)] = stops - counts
        self.n_parts, self.n_ids = len(keep), len(ids)
        self.ids[: len(ids)] = ids
        self.table[:] = -1
        self._enter(0, self.n_parts)

    def _learn(self, parts: list[str], words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Encodes parts and keeps them; their indices."""
        first, n = self.n_parts, len(parts)
        for x in range(0, n, self.at_once):
            ids, counts = self.encode_parts(parts[x : x + self.at_once])
            if self.n_ids + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), np.uint32)])
            a = first + x
            self.counts[a : a + len(counts)], self.begins[a : a + len(counts)] = counts, self.n_ids + np.cumsum(counts) - counts
            self.ids[self.n_ids : self.n_ids + len(ids)] = ids
            self.n_ids += len(ids)
        self.words[:, first : first + n], self.sizes[first : first + n] = words, sizes
        self.n_parts += n
        self._enter(first, n)
        return np.arange(first, first + n)

    def _encode(self, raw: memoryview, eights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some parts, one after the other, and the count of each."""
        sizes = ends - starts
        short = np.flatnonzero(sizes <= LONGEST_KEPT)
        a, n = starts[short], sizes[short]
        words = np.zeros((_WORDS, len(short)), np.uint64)
        for k in range(_WORDS):
            own = np.flatnonzero(n > 8 * k)
            words[k, own] = eights[a[own] + 8 * k] & _LOW_BYTES[np.minimum(n[own] - 8 * k, 8)]
        hashes = self._hashes(words, n)
        slots = self._slots(hashes)
        found = self._find(slots, words, n)
        self.now += 1
        own = np.zeros(len(starts), bool)  # parts encoded for this time alone
        own[sizes > LONGEST_KEPT] = True
        if len(fresh := np.flatnonzero(found < 0)):
            if self.n_parts + len(fresh) > MOST_KEPT:
                self._make_room()
                found = self._find(slots, words, n)
                fresh = np.flatnonzero(found < 0)
            _, first, codes = np.unique(hashes[fresh], return_index=True, return_inverse=True)
            other = ~self._same(words, n, fresh[first][codes], words[:, fresh], n[fresh])  # of one hash, but not one text
            own[short[fresh[other]]] = True
            head = fresh[first]
            found[fresh] = self._learn([str(raw[x:y], "utf-8") for x, y in zip(a[head].tolist(), (a[head] + n[head]).tolist(), strict=True)], words[:, head], n[head])[codes]
        self.met[found] = self.now
        begins, counts, ids = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64), self.ids
        begins[short], counts[short] = self.begins[found], self.counts[found]
        if len(alone := np.flatnonzero(own)):
            extra, counts[alone] = self.encode_parts([str(raw[x:y], "utf-8") for x, y in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)])
            begins[alone] = self.n_ids + np.cumsum(counts[alone]) - counts[alone]
            ids = np.concatenate([ids[: self.n_ids], extra])
        stops = np.cumsum(counts)
        return ids[np.repeat(begins - (stops - counts), counts) + np.arange(int(stops[-1]))], counts

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of a block, one after the other, and the count of each row."""
        rows = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        data, offsets, starts = self.parts(data, offsets)
        raw, ends = memoryview(np.ascontiguousarray(data)), np.append(starts[1:], len(data))
        ids, counts = [], []
        for x in range(0, len(starts), _LOOKED_UP):
            a, b = starts[x : x + _LOOKED_UP], ends[x : x + _LOOKED_UP]
            low, high = int(a[0]), int(b[-1])
            own, n = self._encode(raw[low:high], _eights(data[low:high]), a - low, b - low)
            ids.append(own), counts.append(n)
        stops = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        return ids[0] if len(ids) == 1 else np.concatenate(ids), np.diff(stops[np.searchsorted(starts, offsets)])


#: Words of letters below this code point go to the library's model at once, past its pattern.
_PLAIN_BELOW = 0x250


class Encoder(PartEncoder):
    """By the tokenizers library, as it encodes a whole text without the special tokens that it would add.

    Strings of added tokens in a text become those tokens. A word of plain letters is one match of the tokenizer's pattern, so that
    its model gives the ids at once; all else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        kind = spec.get("pre_tokenizer") or {}
        byte_level = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space")
        added = spec.get("added_tokens") or []
        self.kinds = classes("".join(x["content"] for x in added).encode())  # no added token is cut
        greedy = any(x["lstrip"] or x["rstrip"] or x["single_word"] or len(self._cut(x["content"])) != 1 for x in added)
        self.cut = bool(byte_level and not greedy and not any(spec.get(x) for x in ("normalizer", "truncation", "padding")))
        split, self.written = self.whole.pre_tokenizer.pre_tokenize_str if self.cut else None, {}
        for c in map(chr, range(_PLAIN_BELOW if self.cut else 0)):
            if c.isalpha() and len(found := split(f"a{c}a")) == 1:
                self.written[ord(c)] = found[0][0][1:-1]
        if self.written:
            self.written[32] = split(" a")[0][0][:-1]
        letters = "".join(re.escape(chr(c)) for c in self.written if c != 32)
        plain = bool(letters) and not any(re.fullmatch(f"[ {letters}]*", x["content"]) for x in added)
        self.plain = re.compile(f" ?[{letters}]+").fullmatch if plain else lambda part: None
        self.model = self.whole.model

    def _cut(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        return cuts(raw, np.array([0, len(raw)], np.int64), self.kinds)

    def parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return data, offsets, cuts(data, offsets, self.kinds) if self.cut else np.unique(offsets[offsets < len(data)])

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain, model, written, ids, counts, others = self.plain, self.model.tokenize, self.written, [], [], []
        for k, part in enumerate(parts):
            if plain(part):
                found = model(part.translate(written))
                ids += [x.id for x in found]
                counts.append(len(found))
            else:
                others.append(k)
                counts.append(0)
        counts = np.array(counts, np.int64)
        if not others:
            return np.array(ids, np.uint32), counts
        each = [x.ids for x in self.whole.encode_batch_fast([parts[k] for k in others], add_special_tokens=False)]
        of_plain = counts.copy()
        counts[others] = [len(x) for x in each]
        out = np.empty(int(counts.sum()), np.uint32)
        from_whole = np.repeat(of_plain == 0, counts)
        out[from_whole], out[~from_whole] = [i for x in each for i in x], ids
        return out, counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker and file."""
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of each row followed by end."""
    stops = np.cumsum(counts + 1)
    out = np.empty(len(ids) + len(counts), np.uint32)
    last = np.zeros(len(out), bool)
    last[stops - 1] = True
    out[last], out[~last] = end, ids
    return out, counts + 1

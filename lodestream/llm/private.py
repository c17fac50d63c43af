"""Information-theoretic sanitisation of personal data.

Addresses, numbers, cards and secrets (values of at least eight characters, a digit among them, that are assigned to a name such as
token or password) are found by pattern. They are the protected entities: for each entity that occurs often enough, all
terms of all documents that show it are counted, and a term's disclosure of an entity is PMI(entity; term) / IC(entity), which is 1
for a term that occurs with that entity alone and 0 for one that says nothing of it. It is taken twice, and the higher one holds:
over the words next to a mention (as many as CONTEXT_WORDS on a side) and over whole documents, where the entity's share is that of
the documents showing it. A term whose disclosure reaches a threshold, that leaves at most HIDDEN bits of the entity hidden, and that was seen in
enough different contexts, is generalised or, from a higher threshold, removed, wherever it occurs. The contexts are enough if there
are SUPPORT of them and chance wouldn't bring them about: each weighs as many bits as it is unlikely that an occurrence falls to the
entity, and together they must outweigh the corpus's terms, all of which might have met it, by EVIDENCE bits. A context is the passage that spans a mention's next words and the term, so that copies
of one passage count once; a term has one for each mention that is the nearest to it. Terms inside entities aren't counted.

A term is a run of letters, marks, digits and connectors of any script, compared under Unicode's full case folding; soft hyphens
and joiners inside it don't count. Scripts written without spaces have no such runs: there every run of up to GRAMS code points is
a term, so that a longer name is found by its parts.

Counts cover all documents. Of the terms only a bitmap of fixed size and, up to BROADCAST_TERMS, the disclosing ones are sent
to executors; beyond that they are joined.

Defined results: null text counts as empty; null or repeated doc_ids return a row each; an empty table gives no rows; digits of
any number in a match are read whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import fingerprints
from .common import free_names, store, text_blocks

KINDS = ("email", "ip", "card", "phone")
#: The kind that is protected beside the base kinds.
SECRET = "secret"
#: Words on either side of a mention that are next to it.
CONTEXT_WORDS = 8
#: Code points of the longest term in a script without spaces.
GRAMS = 4
#: Different contexts that must show a term beside an entity.
SUPPORT = 3
#: Bits by which contexts must outweigh the corpus, and bits of an entity that a term may leave hidden: with 1 it is the more likely one.
EVIDENCE, HIDDEN = 10.0, 1.0
#: Disclosure from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.9, 0.97
_BUCKETS = 1 << 20
#: Bytes of text that are cut into terms at once, by arrays of a multiple of that size.
_BLOCK = 1 << 18
#: Rows of terms that a worker holds before it hands them on.
_ROWS = 1 << 16
BROADCAST_TERMS = 500_000

# The patterns of the base kinds, with parts that can't overlap.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Names that secrets are assigned to, and such an assignment.
_SECRET_NAMES = ("token", "password", "passwd", "secret", "api_key", "api-key", "apikey", "access_key", "private_key")
_ASSIGNED = re.compile(rf"(?:{'|'.join(_SECRET_NAMES)})[\"']?[ \t]*[:=][ \t]*[\"']?([^\s\"',;]{{7,}}[A-Za-z0-9+/=])", re.IGNORECASE)

_MARKS = np.zeros(256, bool)
_MARKS[[ord("@"), *range(48, 58)]] = True

# Code points from _PLANES on hold no letters; those from _IDEOGRAPHS on are ideographs.
_IDEOGRAPHS, _PLANES = 0x20000, 0x40000
_BETWEEN, _SPACED, _UNSPACED, _AS_BEFORE = range(4)
_SCRIPTS = ("CJK ", "IDEOGRAPHIC ", "HIRAGANA ", "KATAKANA", "HALFWIDTH KATAKANA", "HENTAIGANA ", "BOPOMOFO ", "THAI ", "LAO ", "KHMER ", "MYANMAR ", "TAI ", "NEW TAI LUE ", "JAVANESE ", "BALINESE ")
#: Soft hyphen, non-joiner, joiner, word joiner, no-break space of no width.
_IGNORED = (0xAD, 0x200C, 0x200D, 0x2060, 0xFEFF)


@lru_cache(maxsize=1)
def _code_points() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: its place in terms, the length of its folded form, that form, and a value for fingerprints."""
    place, length = np.zeros(_PLANES + 1, np.int8), np.ones(_PLANES + 1, np.int64)
    forms = np.repeat(np.arange(_PLANES + 1, dtype=np.uint32)[:, None], 3, axis=1)
    place[_IDEOGRAPHS:_PLANES] = _UNSPACED
    for k in range(_IDEOGRAPHS):
        c = chr(k)
        kind = unicodedata.category(c)
        if kind[0] in "LMN" or kind == "Pc":
            own = unicodedata.name(c, "").startswith(_SCRIPTS)
            place[k] = _UNSPACED if own else _AS_BEFORE if kind[0] == "M" else _SPACED
        if (folded := c.casefold()) != c:
            length[k] = len(folded)
            forms[k, : len(folded)] = [ord(x) for x in folded]
    place[list(_IGNORED)], length[list(_IGNORED)] = _AS_BEFORE, 0
    return place, length, forms, np.random.default_rng(43).integers(1, 1 << 63, _PLANES + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            low = found.end()
            yield start, low
        else:
            low = at + 1
        at = text.find("@", low)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for chain in _DOTTED.finditer(text):
        parts = chain[0].split(".")
        at = chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            n = sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, at + n
            at += n + 1


def _luhn(digits: str) -> bool:
    own = [int(x) for x in reversed(digits)]
    return sum(own[::2] + [2 * x - 9 * (x > 4) for x in own[1::2]]) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for found in _CARD.finditer(text):
        digits = found[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            yield found.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for found in _PHONE.finditer(text):
        if 8 <= sum("0" <= x <= "9" for x in found[0]) <= 15:
            yield found.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Kind, start and end (code points, end exclusive), by kind and then start."""
    return [(kind, a, b) for kind, find in zip(KINDS, (_emails, _ips, _cards, _phones), strict=True) for a, b in find(text)]


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    low = text.lower()
    if any(x in low for x in _SECRET_NAMES):
        for found in _ASSIGNED.finditer(text):
            if any("0" <= x <= "9" for x in found[1]):
                yield found.span(1)


def all_spans(text: str) -> list[tuple[str, int, int]]:
    """base_spans(), and behind them those of secrets."""
    return [*base_spans(text), *((SECRET, a, b) for a, b in _secrets(text))]


def _marked(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with a digit or an at sign; no other row has a span."""
    sums = np.concatenate([[0], np.cumsum(_MARKS[data])])
    return np.diff(sums[offsets]) > 0


def _merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of spans."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    return starts, ends


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (code points of the block) and fingerprints of all terms of a block, and where its rows begin and end."""
    place, length, forms, values = _code_points()
    points = np.minimum(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4"), _PLANES).astype(np.int64)
    n = len(points)
    rows = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    kind = place[points]
    first = rows[rows < n]
    kind[first] = np.where(kind[first] == _AS_BEFORE, _BETWEEN, kind[first])
    kind = kind[np.maximum.accumulate(np.where(kind != _AS_BEFORE, np.arange(n), 0))]
    edge = np.ones(n + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[rows] = True
    bounds = np.flatnonzero(edge)
    starts, ends = bounds[:-1], bounds[1:]
    own = kind[starts]
    if (own == _UNSPACED).any():
        a, b = starts[own == _UNSPACED], ends[own == _UNSPACED]
        at, stop = np.flatnonzero(kind == _UNSPACED), np.repeat(b, b - a)
        grams = [(at[at + k <= stop], k) for k in range(1, GRAMS + 1)]
        starts = np.concatenate([starts[own == _SPACED], *(x for x, _ in grams)])
        ends = np.concatenate([ends[own == _SPACED], *(x + k for x, k in grams)])
        order = np.lexsort((ends, starts))
        starts, ends = starts[order], ends[order]
    else:
        starts, ends = starts[own == _SPACED], ends[own == _SPACED]
    widths = length[points]
    if (widths == 1).all():
        return starts, ends, fingerprints(forms[points, 0], starts, ends, values), rows
    to = np.concatenate([[0], np.cumsum(widths)])
    solid = to[ends] > to[starts]
    starts, ends = starts[solid], ends[solid]
    each = np.repeat(np.arange(n), widths)
    folded = forms[points[each], np.arange(len(each)) - to[each]]
    return starts, ends, fingerprints(folded, to[starts], to[ends], values), rows


def _term_hash(terms: list[str]) -> np.ndarray:
    stops = np.cumsum([len(x) for x in terms], dtype=np.int64)
    points = np.frombuffer("".join(terms).encode("utf-32-le"), "<u4")
    return fingerprints(points, np.concatenate([[0], stops[:-1]]).astype(np.int64), stops, _code_points()[3])


def _mentions(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Entity (an odd hash) and start of each span."""
    return (_term_hash([f"{kind}:{text[a:b].lower()}" for kind, a, b in spans]) | np.uint64(1)).view(np.int64), np.array([a for _, a, _ in spans], np.int64)


def _outer(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Starts and fingerprints of a block's terms that touch no span, where its rows begin and end, and the mentions by row."""
    starts, ends, hashes, begins = _terms(data, offsets)
    found, lows, highs = {}, [], []
    for k in np.flatnonzero(_marked(data, offsets)).tolist():
        text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
        if spans := all_spans(text):
            found[k] = _mentions(text, spans)
            a, b = _merged(spans)
            lows.append(np.array(a) + begins[k]), highs.append(np.array(b) + begins[k])
    if found:
        low, high = np.concatenate(lows), np.concatenate(highs)
        at = np.searchsorted(low, ends - 1, side="right") - 1
        free = (at < 0) | (high[at] <= starts)
        starts, hashes = starts[free], hashes[free]
    return starts, hashes, begins, found


def _showing(data: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block that mention an entity whose bucket is known, as a block of their own."""
    kept = []
    for k in np.flatnonzero(_marked(data, offsets)).tolist():
        own = data[offsets[k] : offsets[k + 1]]
        text = own.tobytes().decode()
        if (spans := all_spans(text)) and known[_mentions(text, spans)[0] % _BUCKETS].any():
            kept.append(own)
    if not kept:
        return data[:0], np.zeros(1, np.int64)
    return np.concatenate(kept), np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int64)


def _pairs(starts: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For an entity mentioned at some places of a text with terms: term, context, occurrences next to a mention, and occurrences.

    Each occurrence belongs to the nearest mention; a term has one row for each mention that it belongs to.
    """
    # Terms that start together, as those of a script without spaces do, are one word here.
    new = np.diff(starts, prepend=-1) != 0
    word, first = np.cumsum(new) - 1, np.flatnonzero(new)
    n = len(first)
    places = np.unique(np.searchsorted(starts[first], np.sort(at)))
    right = np.searchsorted(places, word, side="right")
    left = np.maximum(right - 1, 0)
    right = np.minimum(right, len(places) - 1)
    gaps = [np.where(places[x] <= word, word - places[x], places[x] - 1 - word) for x in (left, right)]
    own, gap = np.where(gaps[0] <= gaps[1], left, right), np.minimum(*gaps)
    order = np.lexsort((gap, own, hashes))
    head = np.flatnonzero((np.diff(hashes[order].view(np.int64), prepend=0) != 0) | (np.diff(own[order], prepend=-1) != 0))
    chosen = order[head]
    place = places[own[chosen]]
    low, high = np.minimum(np.maximum(place - CONTEXT_WORDS, 0), word[chosen]), np.maximum(np.minimum(place + CONTEXT_WORDS, n), word[chosen] + 1)
    about = fingerprints(np.arange(n), low, high, hashes[first] | np.uint64(1))
    return hashes[chosen], about.view(np.int64), np.add.reduceat((gap < CONTEXT_WORDS)[order].astype(np.int64), head), np.diff(np.append(head, len(order)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _bitmap(df: DataFrame, column: str) -> np.ndarray:
    """Which of _BUCKETS buckets the values of a column fall into."""
    out = np.zeros(_BUCKETS, bool)
    out[df.select(F.pmod(column, F.lit(_BUCKETS)).cast("int").alias("b")).distinct().toArrow().column("b").to_numpy()] = True  # at most _BUCKETS
    return out


def _batch(names: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)) for x in columns], names=names.split())


def disclosing_terms(docs: DataFrame, generalise: float = GENERALISE, support: int = SUPPORT) -> DataFrame:
    """hash and disclosure (its highest over all entities) of the terms that disclose an entity of docs (text)."""
    texts = _texts(docs).select("text", F.xxhash64(F.col("text").cast("string")).alias("key"))

    def entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, keys = 0, batch.column(1).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_blocks(batch, limit=_BLOCK):
                starts, _, begins, found = _outer(data, offsets)
                total += len(starts)
                edges = np.searchsorted(starts, begins)
                rows = []
                for k, (ids, _) in found.items():
                    each, n = np.unique(ids, return_counts=True)
                    rows.append((each, np.full(len(each), keys[row + k]), n, np.full(len(each), edges[k + 1] - edges[k])))
                if rows:
                    yield _batch("id key mentions terms", [np.concatenate(x) for x in zip(*rows, strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *(pa.array([x], pa.int64()) for x in (0, 0, total))], names=["id", "key", "mentions", "terms"])

    seen = store(texts.mapInArrow(entities, "id long, key long, mentions long, terms long"), "entities")
    total = seen.filter("id IS NULL").agg(F.coalesce(F.sum("terms"), F.lit(0))).first()[0]
    each = seen.filter("id IS NOT NULL").groupBy("id", "key").agg(F.max("mentions").alias("once"), F.sum("mentions").alias("mentions"), F.sum("terms").alias("terms"))
    often = each.groupBy("id").agg(F.sum("once").alias("once"), F.sum("mentions").alias("mentions"), F.sum("terms").alias("terms"))
    # An entity has at most a context for each mention in different texts.
    often = store(often.filter(F.col("once") >= support).drop("once"), "often")
    known = _bitmap(often, "id")

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in text_blocks(batch, limit=_BLOCK):
                data, offsets = _showing(data, offsets, known)
                if not len(data):
                    continue
                starts, hashes, begins, found = _outer(data, offsets)
                edges = np.searchsorted(starts, begins)
                rows, size = [], 0
                for k, (ids, at) in found.items():
                    a, b = edges[k], edges[k + 1]
                    own = np.unique(ids[known[ids % _BUCKETS]])
                    if not len(own) or a == b:
                        continue
                    term, n = np.unique(hashes[a:b], return_counts=True)
                    none = np.zeros(len(term), np.int64)
                    rows.append((none, term, none, none, n))  # the text's terms, for no entity
                    size += len(term)
                    for one in own:
                        term, about, near, n = _pairs(starts[a:b] - begins[k], hashes[a:b], at[ids == one])
                        rows.append((np.full(len(term), one), term, about, near, n))
                        size += len(term)
                        if size >= _ROWS:
                            yield _batch("id hash about near n", [np.concatenate(x) for x in zip(*rows, strict=True)])
                            rows, size = [], 0
                if rows:
                    yield _batch("id hash about near n", [np.concatenate(x) for x in zip(*rows, strict=True)])

    if not known.any():
        return often.select(F.col("id").alias("hash"), F.lit(0.0).alias("disclosure"))
    met = store(texts.select("text").mapInArrow(contexts, "id long, hash long, about long, near long, n long").groupBy("id", "hash", "about").agg(F.sum("near").alias("near"), F.sum("n").alias("n")), "met")
    pairs = met.filter("id != 0").groupBy("id", "hash").agg(F.sum("near").alias("near"), F.sum("n").alias("both"), F.count("*").alias("contexts"), F.count_if(F.col("near") > 0).alias("near_contexts"))
    pairs = store(pairs.filter(F.col("contexts") >= support).join(often, "id"), "pairs")
    # Beside a mention there are several words, so that its most frequent neighbour may be met more often than itself.
    beside = pairs.filter(F.col("near_contexts") >= support).groupBy("id").agg(F.max("near").alias("neighbours"))
    pairs = pairs.join(beside, "id", "left")

    def share(both: str, mass: Column, contexts: str, places: Column) -> Column:
        bits, hidden = F.log2(F.lit(float(total)) / mass), F.log2(F.greatest(F.col("occurs") / F.col(both), F.lit(1.0)))
        evidence = F.col(contexts) * F.log2(F.lit(float(total)) / places)
        sound = (F.col(contexts) >= support) & (evidence >= math.log2(max(total, 1)) + EVIDENCE) & (hidden <= HIDDEN)
        return F.when((bits > 0) & (F.col(both) > 0) & sound, 1 - hidden / bits).otherwise(0.0)

    near = share("near", F.greatest("mentions", F.coalesce("neighbours", F.lit(0))), "near_contexts", F.least(F.col("mentions") * 2 * CONTEXT_WORDS, F.col("terms")))
    disclosure = F.round(F.greatest(near, share("both", F.col("terms"), "contexts", F.col("terms"))), 9)
    # A term occurs at least as often as in the texts met, so that no term is counted that can't reach the bound.
    least = met.filter("id = 0").select("hash", F.col("n").alias("occurs"))
    pairs = store(pairs.join(least, "hash").filter(disclosure >= generalise).drop("occurs"), "candidates")
    wanted = _bitmap(pairs, "hash")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, often = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, data, offsets in text_blocks(batch, limit=_BLOCK):
                hashes = _outer(data, offsets)[1].view(np.int64)
                own, n = np.unique(hashes[wanted[hashes % _BUCKETS]], return_counts=True)
                held, at = np.unique(np.concatenate([held, own]), return_inverse=True)
                often = np.bincount(at, np.concatenate([often, n]), len(held)).astype(np.int64)
                if len(held) >= _ROWS:
                    yield _batch("hash n", [held, often])
                    held, often = held[:0], often[:0]
        yield _batch("hash n", [held, often])

    if not wanted.any():
        return pairs.select("hash", F.lit(0.0).alias("disclosure"))
    occurs = texts.select("text").mapInArrow(counts, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("occurs"))
    joined = pairs.join(occurs, "hash").groupBy("hash").agg(F.max(disclosure).alias("disclosure"))
    return store(joined.filter(F.col("disclosure") >= generalise), "disclosing")


def _hits(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """Rows with terms of keys (ascending): the row, and start, end (code points) and index of the key of each."""
    starts, ends, hashes, begins = _terms(data, offsets)
    hashes = hashes.view(np.int64)
    place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    hit = np.flatnonzero(keys[place] == hashes)
    if not len(hit):
        return
    rows = np.searchsorted(begins, starts[hit], side="right") - 1
    a, b = (starts[hit] - begins[rows]).tolist(), (ends[hit] - begins[rows]).tolist()
    edges = [0, *(np.flatnonzero(np.diff(rows)) + 1).tolist(), len(hit)]
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        yield int(rows[x]), list(zip(a[x:y], b[x:y], place[hit[x:y]].tolist(), strict=True))


def _outside(terms: list[tuple[int, int, int]], spans: list[tuple[str, int, int]], shares: np.ndarray) -> list[tuple[int, int, int]]:
    """The terms that touch no span; those that overlap become one, with the highest disclosure of them."""
    starts, ends = _merged(spans)
    out: list[tuple[int, int, int]] = []
    for a, b, k in terms:
        if (i := bisect_right(starts, b - 1) - 1) >= 0 and ends[i] > a:
            continue
        if out and a < out[-1][1]:
            low, high, own = out[-1]
            out[-1] = low, max(high, b), k if shares[k] > shares[own] else own
        else:
            out.append((a, b, k))
    return out


def _written(text: str, spans: list[tuple[str, int, int]], terms: list[tuple[int, int, int]], shares: np.ndarray, remove: float) -> str:
    """text with spans replaced by their kind, terms by their shape, and the most disclosing terms removed."""
    out, at = [], 0
    every = [(a, b, f"[{kind.upper()}]") for kind, a, b in spans]
    for a, b, k in terms:
        word = text[a:b]
        shape = "[NUMBER]" if any(x.isdigit() for x in word) else "[NAME]" if word[:1].isupper() else "[WORD]"
        every.append((a, b, "" if shares[k] >= remove else shape))
    for a, b, what in sorted(every):
        if a >= at:
            out += [text[at:a], what]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


class Sanitiser:
    """Spans and sanitised texts under given disclosing terms."""

    def __init__(self, terms: DataFrame, remove: float = REMOVE):
        self.terms, self.remove = terms, remove
        self.joined = terms.limit(BROADCAST_TERMS + 1).count() > BROADCAST_TERMS
        rows = terms.select("hash", "disclosure").filter(F.lit(not self.joined)).toArrow()  # at most BROADCAST_TERMS
        keys, shares = rows.column(0).to_numpy(), rows.column(1).to_numpy()
        order = np.argsort(keys)
        self.keys, self.shares = keys[order], shares[order]

    def rows(self, batch: pa.RecordBatch, column: str, where: str) -> Iterator[tuple[list, list[list[tuple[str, int, int]]], list[list[tuple[int, int, int]]], np.ndarray]]:
        """By block: its first row and count, spans and disclosing terms by row, and the disclosures that terms point to."""
        at = batch.schema.get_field_index(where)
        for row, data, offsets in text_blocks(batch, column, _BLOCK):
            n = len(offsets) - 1
            spans: list = [[] for _ in range(n)]
            for k in np.flatnonzero(_marked(data, offsets)):
                spans[k] = all_spans(data[offsets[k] : offsets[k + 1]].tobytes().decode())
            terms: list = [[] for _ in range(n)]
            shares = self.shares
            if self.joined:
                each = [sorted((x["a"], x["b"], x["disclosure"]) for x in found or ()) for found in batch.column(at).slice(row, n).to_pylist()]
                shares = np.array([s for x in each for _, _, s in x])
                k = 0
                for i, x in enumerate(each):
                    terms[i] = _outside([(a, b, k + j) for j, (a, b, _) in enumerate(x)], spans[i], shares)
                    k += len(x)
            elif len(self.keys):
                for i, x in _hits(data, offsets, self.keys):
                    terms[i] = _outside(x, spans[i], shares)
            yield (row, n), spans, terms, shares

    def located(self, docs: DataFrame, text: str) -> tuple[DataFrame, str]:
        """docs and the name of a further column: with too many terms to broadcast, the terms found in each text, by joins."""
        where, name = free_names(docs, "found", "found_key")
        if not self.joined:
            return docs, where
        wanted = _bitmap(self.terms, "hash")

        def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.column(0).to_pylist()
                for row, data, offsets in text_blocks(batch, limit=_BLOCK):
                    hashes = _terms(data, offsets)[2].view(np.int64)
                    keys = np.unique(hashes[wanted[hashes % _BUCKETS]])
                    out = [(names[row + i], int(keys[k]), a, b) for i, x in (_hits(data, offsets, keys) if len(keys) else ()) for a, b, k in x]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["key", "hash", "a", "b"])

        # Spans depend on the text alone, so copies share them.
        texts = docs.select(F.xxhash64(text).alias("key"), F.col(text).alias("text")).dropDuplicates(["key"])
        found = texts.mapInArrow(hits, "key long, hash long, a long, b long").join(self.terms.select("hash", "disclosure"), "hash")
        found = store(found.groupBy(F.col("key").alias(name)).agg(F.collect_list(F.struct("a", "b", "disclosure")).alias(where)), "located")
        return docs.withColumn(name, F.xxhash64(text)).join(found, name, "left").select(*docs.columns, where), where

    def spans(self, docs: DataFrame) -> DataFrame:
        """Per document of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_term, n_spans, base_sha256 and spans."""
        own = self._shipped()
        rows_of, where = self.located(_texts(docs), "text")

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for (row, n), spans, terms, _ in own.rows(batch, "text", where):
                    counts = [Counter(kind for kind, _, _ in x) for x in spans]
                    base = [_joined([y for y in x if y[0] != SECRET]) for x in spans]
                    every = [_joined([*x, *(("term", a, b) for a, b, _ in y)]) for x, y in zip(spans, terms, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(row, n), *(pa.array([c[kind] for c in counts], pa.int64()) for kind in (*KINDS, SECRET)), pa.array([len(x) for x in terms], pa.int64()), pa.array([len(x) + len(y) for x, y in zip(spans, terms, strict=True)], pa.int64()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]), pa.array(every)],
                        names=["doc_id", *(f"n_{x}" for x in (*KINDS, SECRET)), "n_term", "n_spans", "base_sha256", "spans"],
                    )

        return rows_of.mapInArrow(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_secret long, n_term long, n_spans long, base_sha256 string, spans string")

    def sanitise(self, docs: DataFrame) -> DataFrame:
        """docs with personal data and disclosing terms taken out of text, and n_chars, where there is one, counted anew."""
        own, schema = self._shipped(), docs.schema
        text = next(x for x in docs.columns if x.lower() == "text")
        rows_of, where = self.located(docs, text)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(text)
                for (row, n), spans, terms, shares in own.rows(batch, text, where):
                    columns = [batch.column(k).slice(row, n) for k in range(len(schema))]
                    if changed := [i for i in range(n) if spans[i] or terms[i]]:
                        new = columns[at].to_pylist()
                        for i in changed:
                            new[i] = _written(new[i], spans[i], terms[i], shares, own.remove)
                        columns[at] = pa.array(new, columns[at].type)
                    if "n_chars" in schema.names:
                        k = schema.names.index("n_chars")
                        columns[k] = pc.coalesce(pc.utf8_length(columns[at]).cast(columns[k].type), columns[k])
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return rows_of.mapInArrow(rows, schema)

    def _shipped(self) -> Sanitiser:
        """This without its table, for executors."""
        own = object.__new__(Sanitiser)
        own.__dict__.update({k: v for k, v in self.__dict__.items() if k != "terms"})
        return own


def sanitiser(docs: DataFrame) -> Sanitiser:
    """A sanitiser with the terms that disclose entities of docs."""
    return Sanitiser(disclosing_terms(docs))

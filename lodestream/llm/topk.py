"""Exact top-k search by term-at-a-time accumulation.

Every component of a vector is a term and its integer the weight. A block of candidates is turned into postings, one list of
(row, weight) for each term that any of its rows has; for each query, its own terms alone scatter their weighted postings into a
dense array of scores. Partition selection then keeps the k best of a block beside the k best so far, each task returns its own
k best, and a partial and a final aggregate merge them.

Queries go out in chunks of at most QUERIES rows and QUERY_NUMBERS numbers (32 MB), chosen by a hash of their identifier, so what
is broadcast is bounded however many and however wide they are; each chunk passes over all candidates once and its result is stored.

Defined results: a vector that is null, or holds a null, NaN or infinite component, takes no part, nor does a null vec_id; missing
components of shorter vectors are zero; repeated candidates each take a place; repeated rows of a query are one query, by
the least of their vectors, and no candidate has its vec_id; an empty table gives no rows; scores that could leave 64 bits raise an error; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Queries that are broadcast at once and candidates whose scores are held at once, at most, and the numbers that either may have.
QUERIES, BLOCK = 50_000, 8192
QUERY_NUMBERS, BLOCK_NUMBERS = 1 << 22, 1 << 22
_NONE = np.iinfo(np.int64).min


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and terms (array of long): floor(scale * x) of the vectors that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null")
    return named.filter(sound).select("vec_id", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("terms"))


def _dense(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers of that width: zero where a row is shorter, cut where it is longer."""
    n = np.asarray(pc.list_value_length(column), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(n), width), np.int64)
    row, at = np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    kept = at < width
    out[row[kept], at[kept]] = flat[kept]
    return out


class Accumulator:
    """The k best candidates so far of each query."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, k: int):
        self.ids, self.terms, self.k = ids, terms, k
        self.scores = np.full((len(ids), k), _NONE, np.int64)
        self.found = np.zeros((len(ids), k), np.int64)
        self.most = int(np.abs(terms).max(initial=0))

    def add(self, ids: np.ndarray, weights: np.ndarray) -> None:
        """Scores a block of candidates."""
        order = np.argsort(ids, kind="stable")
        ids, weights = ids[order], weights[order]
        shared = min(weights.shape[1], self.terms.shape[1])
        bound = self.most * int(np.abs(weights).max(initial=0)) * max(1, shared)
        if bound >= 1 << 63:
            raise OverflowError("scores of these vectors don't fit 64 bits")
        kind = np.int32 if bound < 1 << 31 else np.int64
        postings = []
        for t in range(shared):
            rows = np.flatnonzero(weights[:, t])
            full = len(rows) == len(ids)
            postings.append((None if full else rows, np.ascontiguousarray(weights[:, t] if full else weights[rows, t]).astype(kind)))
        scores, part = np.empty(len(ids), kind), np.empty(len(ids), kind)
        for q, own in enumerate(self.terms):
            scores[:] = 0
            for t in np.flatnonzero(own[:shared]).tolist():
                rows, weight = postings[t]
                if rows is None:
                    scores += np.multiply(weight, kind(own[t]), out=part)
                else:
                    scores[rows] += weight * kind(own[t])
            self._select(q, ids, scores)

    def _select(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        least = int(self.scores[q, -1])  # nothing below it has a place
        at = np.flatnonzero(scores >= least) if least > np.iinfo(scores.dtype).min else np.arange(len(ids))
        at = at[ids[at] != self.ids[q]]
        if not len(at):
            return
        own = scores[at]
        if len(at) > self.k:
            cut = np.partition(own, len(own) - self.k)[len(own) - self.k]
            at, own = at[own >= cut], own[own >= cut]
            above = np.flatnonzero(own > cut)  # ids ascend, so the first of the equal ones have the smallest
            pick = np.concatenate([above, np.flatnonzero(own == cut)[: self.k - len(above)]])
            at, own = at[pick], own[pick]
        s, i = np.concatenate([self.scores[q], own.astype(np.int64)]), np.concatenate([self.found[q], ids[at]])
        best = np.lexsort((i, -s))  # free places hold the least integer, which is its own negative: they're put last below
        best = np.concatenate([best[s[best] != _NONE], best[s[best] == _NONE]])[: self.k]
        self.scores[q], self.found[q] = s[best], i[best]


def top_k(vectors: DataFrame, queries: Column, k: int = 5, at_once: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates in vectors (vec_id, terms) for each row that queries selects."""
    spark = vectors.sparkSession
    asked = vectors.filter(queries).groupBy("vec_id").agg(F.min("terms").alias("terms"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("terms")), F.lit(0)).alias("width")).first()
    width = max(1, size["width"])
    at_once = max(1, min(at_once, QUERY_NUMBERS // width))
    chunks = max(1, -(-size["n"] * 5 // (4 * at_once)))  # a fifth to spare for uneven hashing
    schema, parts = "query_id long, vec_id long, score long", []
    for c in range(chunks):
        own = asked if chunks == 1 else asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c)
        rows = own.toArrow()
        if not rows.num_rows:
            continue
        sent = spark.sparkContext.broadcast((rows.column("vec_id").to_numpy(), _dense(rows.column("terms").combine_chunks(), width)))

        def score(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            best = Accumulator(*sent.value, k)
            held: list[pa.RecordBatch] = []
            block = max(1, min(BLOCK, BLOCK_NUMBERS // width))
            for batch in batches:
                held.append(batch)
                if sum(b.num_rows for b in held) >= block:
                    _flush(best, held, width, block)
            _flush(best, held, width, block)
            q, place = np.nonzero(best.scores != _NONE)
            for x in range(0, len(q), 65536):
                i, j = q[x : x + 65536], place[x : x + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(best.ids[i]), pa.array(best.found[i, j]), pa.array(best.scores[i, j])], names=["query_id", "vec_id", "score"])

        found = vectors.select("vec_id", "terms").mapInArrow(score, schema)
        # A window with a limit on its rank keeps k rows of a query before the shuffle and sorts the rest out of memory.
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        out = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if chunks == 1:
            return out
        parts.append(store(out, "top-k"))
        sent.unpersist()
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def _flush(best: Accumulator, held: list[pa.RecordBatch], width: int, block: int) -> None:
    for batch in held:
        for x in range(0, batch.num_rows, block):
            part = batch.slice(x, block)
            best.add(part.column(0).to_numpy(zero_copy_only=False), _dense(part.column(1), width))
    held.clear()

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestream.llm import topk
from lodestream.llm.topk import integer_vectors, top_k

VEC = "vec_id long, embedding array<float>"


def plain(rows, k=5):
    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in sound if i % 50 == 0}):
        own = min(v for i, v in sound if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in sound if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def found(spark, rows, **more):
    got = top_k(integer_vectors(spark.createDataFrame(rows, VEC + ", score int" if len(rows[0]) == 3 else VEC)), F.col("vec_id") % 50 == 0, **more)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


# Halves and quarters are exact as floats, so both sides see the same numbers.
NUMBERS = st.sampled_from([0.0, 0.25, -0.5, 1.0, -1.75, 3.0])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 220), st.lists(NUMBERS, min_size=0, max_size=5)), min_size=1, max_size=80, unique_by=lambda r: r[0]))
def test_scores_are_those_of_all_pairs(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_many_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 7)
    rows = [(k, [0.5, 0.25] if k % 3 else [0.5, -0.25]) for k in range(400)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows, at_once=2) == plain(rows)


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [float("nan"), 1.0], 1), (4, [float("inf"), 1.0], 1), (5, [1.0, 1.0], 1), (None, [9.0, 9.0], 1), (6, [2.0], 1), (50, None, 1), (100, [0.0, 0.0], 1), (7, [1.0, 1.0], 1), (0, [1.0, 2.0], 1)]
    assert found(spark, rows) == plain([r[:2] for r in rows])


def test_nothing_to_search(spark):
    assert found(spark, [(1, [1.0])]) == []
    none = integer_vectors(spark.createDataFrame([], VEC))
    assert top_k(none, F.col("vec_id") % 50 == 0).count() == 0


def test_scores_beyond_64_bits_are_refused(spark):
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(0, [1e12]), (1, [1e12])])


def test_wide_vectors_go_out_in_more_chunks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_NUMBERS", 6)
    monkeypatch.setattr(topk, "BLOCK_NUMBERS", 9)
    rows = [(k, [0.25 * (k % 7), -0.5, 1.0][: 1 + k % 3]) for k in range(260)]
    assert found(spark, rows) == plain(rows)

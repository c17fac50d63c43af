import random

import numpy as np
import pytest

from lodestream.llm import common, simhash
from lodestream.llm.simhash import anchors, keep_one, near_duplicates

from .plain import DOC, ODD, components
from .plain import prose
from .plain import simhash as plain_print


def expected(rows):
    prints = [plain_print(t) for _, t in rows]
    root = components(prints)
    least = {}
    for (k, _), r in zip(rows, root):
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return sorted(((k, f"{p:016x}", least.get(r)) for (k, _), p, r in zip(rows, prints, root)), key=str)


def near_copies():
    rng, rows = random.Random(5), list(ODD)
    for g in range(12):
        words = prose(g, 300).split()
        for c in range(6):
            own = list(words)
            for _ in range(c):
                own[rng.randrange(len(own))] = "changed"
            rows.append((100 + 10 * g + c, " ".join(own)))
    return rows


@pytest.mark.parametrize("tile,fine", [(simhash.TILE, simhash.FINE), (3, simhash.FINE), (simhash.TILE, 0), (3, 0)])
def test_components_are_those_of_all_pairs(spark, tile, fine):
    rows = near_copies()
    found = near_duplicates(spark.createDataFrame(rows, DOC), tile=tile, fine_from=fine).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=str) == expected(rows)


def test_every_pair_within_the_threshold_meets_where_one_is_at_home():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    flips = np.zeros(len(a), np.uint64)
    for k in range(len(a)):
        for b in rng.choice(64, int(rng.integers(0, 5)), replace=False):
            flips[k] |= np.uint64(1) << np.uint64(b)
    for fine in (False, True):
        seen = []
        for prints in (a, a ^ flips):
            index, anchor, home = anchors(prints, fine)
            each = [({}, {}) for _ in prints]
            for i, x, h in zip(index.tolist(), anchor.tolist(), home.tolist()):
                each[i][0][x] = True
                if h:
                    each[i][1][x] = True
            seen.append(each)
        for x, y in zip(*seen):
            assert x[1].keys() & y[0].keys() or y[1].keys() & x[0].keys()


def test_one_row_of_each_group_stays_with_all_its_columns(spark):
    rows = [(*r, k) for k, r in enumerate(near_copies())]
    docs = spark.createDataFrame(rows, DOC + ", fp int").withColumnRenamed("fp", "kept")
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    groups = expected([r[:2] for r in rows])
    ids = [r["doc_id"] for r in kept.collect()]
    named = {c for _, _, c in groups if c is not None}
    assert sorted(x for x in ids if x is not None) == sorted(named)
    assert len(ids) == len({(p, c) if c is None else c for _, p, c in groups})


def test_hot_prints_and_hubs_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    monkeypatch.setattr(simhash, "HUBS_FROM", 0)
    rows = near_copies() + [(2000 + k, "one text that is everywhere in this table") for k in range(300)]
    found = near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in found), key=str) == expected(rows)
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOC + ", kept_named int, Kept_Id int, kept_hash int")
    kept = keep_one(docs)
    assert kept.columns == docs.columns and {tuple(r)[2:] for r in kept.collect()} == {(1, 2, 3)}
    groups = {p if c is None else c for _, p, c in expected(rows)}
    assert kept.count() == len(groups)


def test_an_empty_table_gives_no_rows(spark):
    assert near_duplicates(spark.createDataFrame([], DOC)).count() == 0
    assert keep_one(spark.createDataFrame([], DOC)).count() == 0


def test_more_bits_than_the_anchors_cover_are_refused(spark):
    with pytest.raises(ValueError):
        near_duplicates(spark.createDataFrame([], DOC), threshold=5)

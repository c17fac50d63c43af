"""The pipeline against its stages by plain versions, each on its own input."""

import re

from pyspark.sql import functions as F

from lodestream.llm.common import store

from .plain import BPE, components, crc, ids
from .plain import simhash as plain_print
from .plain import spans as plain_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "12 34", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [docs.unionByName(extra)]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(store(stage(spark, kept[-1], SF), "stage"))
    for x in kept[1:-1]:
        assert x.columns == docs.columns
    texts = [{r["doc_id"]: r["text"] for r in x.collect()} for x in kept[:-1]]
    assert 10_001 not in texts[1] and 10_002 not in texts[1]
    letters = {k for k, t in texts[0].items() if t and len(re.findall("[a-z]", t)) > 60}
    assert len(letters - texts[1].keys()) <= 0.02 * len(letters)
    names = sorted(texts[1])
    root = components([plain_print(texts[1][k]) for k in names])
    assert sorted(texts[2]) == sorted({names[k] for k in root})
    assert texts[3].keys() == texts[2].keys()
    for k, text in texts[3].items():
        assert not plain_spans(text)
        if not plain_spans(texts[2][k]):
            assert len(text) > 0.5 * len(texts[2][k])
    pieces = kept[-1].collect()
    for r in pieces:
        assert r["ids_crc32"] == crc(ids(texts[3][r["doc_id"]], 0)[r["start"] : r["start"] + r["length"]])
    assert sum(r["length"] for r in pieces) == sum(len(ids(t, 0)) for t in texts[3].values())
    assert BPE


def test_run_is_its_stages(spark):
    import corpus_pipeline

    found = corpus_pipeline.run(spark, SF)
    assert found.agg(F.countDistinct("doc_id")).first()[0] > 100


def test_odd_rows_and_an_empty_table(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    real = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(60).collect()]
    again = next(r for r in real if r[1] and len(r[1]) > 300)
    odd = [(None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, " \n", "en", "s", 2), (9004, "12 34", None, "s", 5), (None, again[1] + " more", "en", None, None), again, again, (9005, (again[1] + " ") * 300, None, "s", None)]
    docs = [spark.createDataFrame(real + odd, schema)]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(store(stage(spark, docs[-1], SF), "stage"))
    ids = [[r["doc_id"] for r in x.collect()] for x in docs]
    assert not {9001, 9002, 9003, 9004} & set(ids[1]) and ids[1].count(again[0]) == 3 and 9005 in ids[1]
    assert len(ids[2]) == len(set(ids[2])) and again[0] in ids[2] and sorted(ids[3], key=str) == sorted(ids[2], key=str)
    assert set(ids[4]) == set(ids[3])
    nothing = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, nothing, SF)
        assert out.count() == 0 and (name == "packing" or out.columns == nothing.columns)

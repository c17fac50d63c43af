import random

import numpy as np
import pytest

from lodestream.llm import langid
from lodestream.llm.langid import EMBEDDED, FILTERS, PAD, STEP, WIDTHS, WINDOW, Network, held_out, keep_known, learn, predict
from pyspark.sql import functions as F

from .plain import DOC, ODD, prose

TABLE = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet(TABLE)
    return docs, learn(docs)


def test_held_out_accuracy(spark, trained):
    docs, network = trained
    found = predict(docs, network).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    known = [r for r in found if r["lang_pred"] != "und"]
    assert len(known) > 100
    assert sum(r["lang_pred"] == r["lang"] for r in known) / len(known) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)


def test_nothing_but_text_decides_and_the_fold_teaches_nothing(spark, trained):
    docs, network = trained
    other = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    again = learn(other)
    assert again.labels == network.labels
    np.testing.assert_array_equal(again.filters, network.filters)


def test_odd_rows(spark, trained):
    docs = spark.createDataFrame([(*r, "en") for r in [*ODD, (50, "12 34 !? —"), (51, "Ω")]], DOC + ", lang_pred string")
    found = {(r["doc_id"], r["lang_pred"] == "und") for r in predict(docs, trained[1]).collect()}
    assert {(1, True), (2, True), (3, True), (50, True), (51, False), (5, False)} <= found
    assert predict(docs, trained[1]).count() == docs.count()
    kept = keep_known(docs, trained[1])
    assert kept.columns == docs.columns and {5, 6} <= {r["doc_id"] for r in kept.collect()} <= {4, 5, 6, 7, 8, 9, 51, None}


def plain_rows(network, text):
    """Label, its probability and that of noise: every window by loops over places and filters."""
    raw, wide = (text or "").encode(), max(WIDTHS)
    starts = [0] if len(raw) <= WINDOW else [*range(0, len(raw) - WINDOW, STEP), len(raw) - WINDOW]
    total, weight = np.zeros(len(network.labels) + 1), 0
    for a in starts if raw else []:
        own = list(raw[a : a + WINDOW])
        letters = sum(b > 127 or chr(b).isalpha() for b in own)
        vectors = [network.embedding[b].astype(float) for b in own + [PAD] * (WINDOW - len(own))]
        hidden = []
        for f, size in enumerate(w for w in WIDTHS for _ in range(FILTERS)):
            taps = network.filters[:, f].reshape(wide, EMBEDDED)
            best = max(sum(float(vectors[p + k] @ taps[k]) for k in range(size)) for p in range(WINDOW - wide + 1))
            hidden.append(max(0.0, best + float(network.bias[f])))
        z = np.array(hidden) @ network.out.astype(float) + network.out_bias
        p = np.exp(z - z.max())
        total, weight = total + p / p.sum() * letters, weight + letters
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, None
    share = total / weight
    return network.labels[int(share[:-1].argmax())], float(share[:-1].max()), float(share[-1])


def test_predictions_are_those_of_a_plain_network(spark, trained):
    texts = [r["text"] for r in trained[0].filter("n_chars between 20 and 900").orderBy("doc_id").limit(12).collect()] + ["Ω", "a", "12 - 3", None, prose(4, 90)]
    found = {r["doc_id"]: r for r in predict(spark.createDataFrame(list(enumerate(texts)), DOC), trained[1]).collect()}
    for k, text in enumerate(texts):
        lang, score, _ = plain_rows(trained[1], text)
        assert found[k]["lang_pred"] == lang and abs(found[k]["score"] - score) < 1e-4


def test_noise_is_let_go(spark, trained):
    rng = random.Random(2)
    noise = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789+/=", k=4000)) for _ in range(5)]
    clean = [r["text"] for r in trained[0].filter("lang is not null and n_chars > 200").orderBy("doc_id").limit(40).collect()]
    kept = keep_known(spark.createDataFrame(list(enumerate(noise + clean)), DOC), trained[1])
    ids = {r["doc_id"] for r in kept.collect()}
    assert not ids & set(range(5)) and len(ids) >= 39


def test_a_hot_text_is_drawn_once(spark):
    rows = [(7, "the same text again and again", "en")] * 2000 + [(k, f"ein anderer Satz {k} und noch einer", "de") for k in range(2000)]
    docs = spark.createDataFrame(rows, DOC + ", lang string")
    assert learn(docs, sample=20).labels == ["de", "en"]


def test_columns_that_are_no_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    with pytest.raises(ValueError):
        learn(spark.createDataFrame([(k, "text", str(k)) for k in range(20)], DOC + ", lang string"))


def test_without_labels_nothing_is_known(spark):
    docs = spark.createDataFrame([(1, "some text", None)], DOC + ", lang string")
    assert learn(docs) is None
    assert predict(docs, None).first()["lang_pred"] == "und"
    assert predict(spark.createDataFrame([], DOC), None).count() == 0
    assert learn(spark.createDataFrame([], DOC + ", lang string")) is None


def test_training_separates_two_alphabets():
    """40 windows are one batch, so an epoch is one step."""
    rng = np.random.default_rng(3)
    windows = np.full((40, WINDOW), PAD)
    for k in range(40):
        windows[k, :60] = rng.integers(97, 104, 60) if k % 2 else rng.integers(104, 111, 60)
    targets = np.arange(40) % 2
    network = Network(["a", "b"])
    before = network.probabilities(windows)[np.arange(40), targets].mean()
    network.train(windows, targets, epochs=60)
    assert network.probabilities(windows)[np.arange(40), targets].mean() > max(0.9, before)


def test_a_long_text_is_read_to_its_end(spark, trained):
    docs = trained[0]
    fr, en = (docs.filter(f"lang = '{x}'").orderBy(F.desc("n_chars")).first()["text"] for x in ("fr", "en"))
    mixed = spark.createDataFrame([(1, en[:300] + " " + fr * 20), (2, fr[:300] + " " + en * 20)], DOC)
    assert {r["doc_id"]: r["lang_pred"] for r in predict(mixed, trained[1]).collect()} == {1: "fr", 2: "en"}
    assert prose(1, 2)

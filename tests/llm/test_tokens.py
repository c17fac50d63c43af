import struct
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import bpe
from lodestream.llm.bpe import Encoder, encoder
from lodestream.llm.packing import curve_keys, hilbert, pack_documents
from lodestream.llm.tokenfile import EliasFano, Image, read_token_files, write_image, write_token_files

from .plain import BPE, DOC, ODD, crc, ids, prose


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aA1 .,\n\t\r'_é音  \x0b\x1c\x85!?-"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=6))
def test_ids_of_parts_are_those_of_the_whole(texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    found, counts = encoder(BPE).encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert found.tolist() == [i for t in texts for i in ids(t, 0)[:-1]]
    assert counts.tolist() == [len(ids(t, 0)) - 1 for t in texts]


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", "a", "é", "É.", "×", "ß!", "'s", "1", " ", "  ", "\n", "\t", "\r\n", "\x0b", "_&&", ",", "ſ", "ⅷ", "ªa"]), max_size=40).map("".join), min_size=1, max_size=4))
def test_added_tokens_and_edges_of_words(texts):
    found, _ = encoder(BPE).encode(*block(texts))
    assert found.tolist() == [i for t in texts for i in ids(t, 0)[:-1]]


def test_the_end_of_text_is_one_token():
    assert encoder(BPE).encode(*block(["<|endoftext|> hi"]))[0].tolist() == [50256, 23105]


def test_a_full_table_lets_go_of_parts(monkeypatch):
    monkeypatch.setattr(bpe, "MOST_KEPT", 64)
    monkeypatch.setattr(bpe, "_SLOT_BITS", 7)
    monkeypatch.setattr(bpe, "_LOOKED_UP", 30)
    own, texts = Encoder(BPE), [prose(k % 7, 40) + " the a" for k in range(30)]
    for t in texts:
        assert own.encode(*block([t]))[0].tolist() == ids(t, 0)[:-1]
    assert own.n_parts <= 64


def test_parts_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(Encoder, "_hashes", staticmethod(lambda words, sizes: np.full(len(sizes), 5, np.uint64)))
    own = Encoder(BPE)
    for t in ["one two three two", "four one five " + "x" * 40, "two six"]:
        assert own.encode(*block([t]))[0].tolist() == ids(t, 0)[:-1]


@given(st.lists(st.integers(0, 100_000), max_size=300))
def test_select_returns_every_boundary(steps):
    values = np.cumsum(np.array(steps, np.int64))
    own, end = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    assert own.select(np.arange(len(values))).tolist() == values.tolist()
    assert end == len(EliasFano.of(values).to_bytes())


def test_boundaries_take_few_bits():
    values = np.cumsum(np.full(100_000, 700))
    assert len(EliasFano.of(values).to_bytes()) * 8 / len(values) < 2 + np.log2(700) + 1


def test_an_image_returns_any_document():
    image = Image(write_image([5, None, 7], np.array([1, 2, 70_000, 4], np.uint32), np.array([2, 0, 2])))
    assert image.doc_ids == [5, None, 7] and image.document(2).tolist() == [70_000, 4] and image.document(1).tolist() == []


def test_files_give_back_ids_and_offsets(spark):
    rows = ODD + [(k, prose(k, 50)) for k in range(100, 160)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOC + ", start int")
    found = read_token_files(write_token_files(docs, BPE, 2, segment_ids=500)).orderBy("start").collect()
    assert len(found) == len(rows)
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in found) == sorted((str(k), len(ids(t, 2)), crc(ids(t, 2))) for k, t in rows)
    named = [r["doc_id"] for r in found if r["doc_id"] is not None]
    assert named == sorted(named)


def test_pieces_hold_each_id_once_and_fill_sequences(spark):
    rows = ODD + [(k, prose(k, k)) for k in range(100, 260)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOC + ", key int")
    found = pack_documents(docs, BPE, 0, 256).collect()
    whole = {}
    for k, t in rows:
        whole.setdefault((k, len(ids(t, 0))), []).append(ids(t, 0))
    for r in found:
        assert any(r["ids_crc32"] == crc(x[r["start"] : r["start"] + r["length"]]) for x in whole[r["doc_id"], r["doc_tokens"]])
    assert sum(r["length"] for r in found) == sum(len(x) for v in whole.values() for x in v)
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    sizes = []
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        sizes.append(at)
    assert max(sizes) <= 256 and all(n & (n - 1) == 0 for n in sizes)


def test_packing_follows_the_curve(spark):
    rows = [(k, prose(k % 50, 30 + k % 11)) for k in range(400)] + [(None, "same words again")] * 60
    docs = spark.createDataFrame(rows, DOC).repartition(3)
    found = pack_documents(docs, BPE, 0, 64).collect()
    key = {(k, len(ids(t, 0))): int(curve_keys(*block([t]))[0]) for k, t in rows}
    order = [key[r["doc_id"], r["doc_tokens"]] for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"]))]
    assert len(set(key.values())) > 40 and order == sorted(order)
    copies = {r["sequence_id"] >> 40 for r in found if r["doc_id"] is None}
    assert len({r["sequence_id"] >> 40 for r in found}) == 4 and sum(r["length"] for r in found) == sum(len(ids(t, 0)) for _, t in rows)
    assert copies


def test_equal_rows_spread_over_ranges(spark):
    docs = spark.createDataFrame([(None, "the same words in each of these rows")] * 400, DOC).repartition(3)
    found = pack_documents(docs, BPE, 0, 64).collect()
    n = Counter(r["sequence_id"] >> 40 for r in found)
    assert len(n) == 4 and max(n.values()) < 2 * min(n.values())


def test_the_curve_visits_each_cell_by_unit_steps():
    points = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    order = hilbert(points, 3)
    assert sorted(order.tolist()) == list(range(512))
    path = points[np.argsort(order)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert pack_documents(none, BPE, 0).count() == 0
    assert read_token_files(write_token_files(none, BPE, 2)).count() == 0
    assert struct.calcsize("<QBQQ") == 25

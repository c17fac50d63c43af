import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm.pieces import MARK, count_tokens, decode, encode, piece_counter, piece_encoder

from .plain import DOC, ODD, PIECES, prose


def viterbi(word, vocabulary, table):
    """Ids of a word: every end takes the best sum of 32-bit scores, the longest last piece among equals."""
    n = len(word)
    best = [(np.float32(0), 0, -1)] + [None] * n
    for end in range(1, n + 1):
        for begin in range(max(0, end - 64), end):
            piece = table.get(word[begin:end])
            score = vocabulary.scores[piece] if piece is not None else vocabulary.unknown if end - begin == 1 else None
            if score is not None and (best[end] is None or best[begin][0] + score > best[end][0]):
                best[end] = (best[begin][0] + score, begin, -1 if piece is None else piece)
    out, end = [], n
    while end:
        _, begin, piece = best[end]
        out = ([piece] if piece >= 0 else [int(vocabulary.byte_ids[b]) for b in word[begin:end].encode()]) + out
        end = begin
    return out


def plain(text):
    v = piece_encoder(PIECES).vocabulary
    table = {v.pieces[k]: k for k in v.normal}
    if not text:
        return []
    marked, words = MARK + text.replace(" ", MARK), []
    for c in marked:
        if c == MARK and (not words or words[-1][-1] != MARK) or not words:
            words.append(c)
        else:
            words[-1] += c
    return [i for w in words for i in viterbi(w, v, table)]


def ids_of(texts, own):
    raw = [t.encode() for t in texts]
    return own.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aabcdet  .▁\n1é音"), st.characters(codec="utf-8")), max_size=30), min_size=1, max_size=5))
def test_ids_and_counts_are_those_of_a_plain_search(texts):
    found, _ = ids_of(texts, piece_encoder(PIECES))
    want = [plain(t) for t in texts]
    assert found.tolist() == [i for x in want for i in x]
    each, words = ids_of(texts, piece_counter(PIECES))
    sums = np.concatenate([[0], np.cumsum(each)])
    assert np.diff(sums[np.concatenate([[0], np.cumsum(words)])]).tolist() == [len(x) for x in want]


@pytest.mark.parametrize("word", ["abcde" * 100, "the" * 90 + " " + "x" * 300, "é" * 250])
def test_long_words(word):
    found, _ = ids_of([word], piece_encoder(PIECES))
    assert found.tolist() == plain(word)
    assert int(ids_of([word], piece_counter(PIECES))[0].sum()) == len(found)


def test_texts_come_back(spark):
    rows = [r for r in ODD if r[0] != 9] + [(k, prose(k, 80)) for k in range(100, 120)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], DOC + ", ids int")
    found = decode(encode(docs, PIECES), PIECES).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in found) == sorted((str(k), t or "") for k, t in rows)
    counted = sorted((str(r["doc_id"]), r["n_tokens"]) for r in count_tokens(docs, PIECES).collect())
    assert counted == sorted((str(r["doc_id"]), r["n_pieces"]) for r in found)
    small = next(r for r in found if r["doc_id"] == 4)
    assert small["ids_crc32"] == zlib.crc32(np.array(plain("one"), "<u4").tobytes())


def test_a_literal_mark_is_a_space(spark):
    docs = spark.createDataFrame([(1, "a▁b")], DOC)
    assert decode(encode(docs, PIECES), PIECES).first()["text"] == "a b"


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert decode(encode(none, PIECES), PIECES).count() == 0 and count_tokens(none, PIECES).count() == 0

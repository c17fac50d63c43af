import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from lodestream.functions import audio, hashing, numbers, text


def values(spark, *columns):
    return list(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def test_lengths_of_audio(spark):
    n = F.col("n")
    mel = spark.createDataFrame([(x,) for x in range(1, 7)], "n long").orderBy("n")
    assert [r[0] for r in mel.select(audio.encoder_frames(n)).collect()] == [1, 1, 2, 2, 3, 3]
    frames = audio.chunked_encoder_frames(n)
    rows = spark.createDataFrame([(304_000,), (720_000,)], "n long").orderBy("n").select(frames.alias("f"), audio.projected_tokens(frames), audio.projected_tokens(frames, boundaries=True)).collect()
    assert [tuple(r) for r in rows] == [(950, 238, 240), (2250, 563, 565)]
    assert values(spark, audio.chunked_encoder_frames(F.lit(0)), audio.chunked_encoder_frames(F.lit(480_000))) == [0, 1500]
    assert values(spark, audio.tokens_per_item(F.lit(10**6), F.lit(1)), audio.tokens_per_item(F.lit(100), F.lit(3))) == [9002, 33]
    for budget in (1, 2, 3, 50):
        made = values(spark, audio.dummy_samples(F.lit(budget)))[0]
        assert budget <= 2 and made == 1 or values(spark, audio.projected_tokens(audio.chunked_encoder_frames(F.lit(made)), boundaries=True))[0] == budget


@pytest.mark.parametrize("key", ["a", "é", "0"])
def test_buckets_are_those_of_any_sha256(spark, key):
    want = int.from_bytes(hashlib.sha256(f"1337\0002\0{key}".encode()).digest()[:8], "big")
    assert values(spark, *(hashing.stable_bucket(1337, 2, F.lit(key), n) for n in (1, 7, 1 << 40))) == [want % n for n in (1, 7, 1 << 40)]
    with pytest.raises(Exception, match="positive"):
        values(spark, hashing.stable_bucket(1, 1, F.lit(key), 0))


def test_canonical_hash(spark):
    raw = '{"b": [1, null], "a": "é"}'
    want = hashlib.sha256(b'{"a":"\\u00e9","b":[1,null]}').hexdigest()
    assert values(spark, hashing.canonical_json_hash(F.lit(raw))) == [want] and hashing.canonical_hash(json.loads(raw)) == want


def test_a_fingerprint_ignores_order_but_not_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    mark = hashing.fingerprint(a, ["a", "b"]).first()
    assert hashing.fingerprint(a.orderBy(F.desc("a")).repartition(3), ["a", "b"]).first() == mark
    assert hashing.fingerprint(a.distinct(), ["a", "b"]).first() != mark
    assert hashing.fingerprint(a.limit(0), ["a", "b"]).first()["n_rows"] == 0


def flac(rate, channels, samples):
    packed = rate << 44 | (channels - 1) << 41 | 15 << 36 | samples
    return b"fLaC" + bytes([0x80]) + (34).to_bytes(3, "big") + bytes(10) + packed.to_bytes(8, "big") + bytes(16)


def test_streaminfo(spark):
    rows = [(flac(16_000, 1, 123_456),), (flac(655_350, 8, (1 << 36) - 1),), (b"nothing",), (b"fLaC" + bytes([1]) + bytes(40),), (None,)]
    found = spark.createDataFrame(rows, "h binary").select(audio.streaminfo(F.col("h")).alias("i")).collect()
    assert [tuple(r["i"]) if r["i"] else None for r in found] == [(16_000, 1, 123_456), (655_350, 8, (1 << 36) - 1), None, None, None]
    assert values(spark, audio.exact_source(F.lit(5), F.lit(None)), audio.exact_source(F.lit(0), F.lit(9)), audio.exact_source(F.lit(0), F.lit(1 << 62))) == ["flac_streaminfo", "libsndfile_header", "flac_empty"]


def test_waveforms(spark):
    wave = F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0, 5.0]))
    assert values(spark, audio.chunks(wave, 2), audio.stacked(wave, 3)) == [[[1, 2], [3, 4], [5]], [[1, 2, 3], [4, 5, 0]]]
    with pytest.raises(Exception, match="finite"):
        values(spark, audio.chunks(F.array(F.lit(float("nan"))), 2))
    faults = [audio.raw_audio_fault(w, F.lit(r), 30) for w, r in ((wave, 16_000), (wave, 8_000), (F.array().cast("array<double>"), 16_000), (F.array(F.lit(float("inf"))), 16_000))]
    assert values(spark, *faults) == [None, "sample_rate", "empty", "not_finite"]
    assert values(spark, audio.feature_fault(F.array(F.lit(2), F.lit(3)), F.lit(5)), audio.feature_fault(F.array(F.lit(2)), F.lit(5))) == [None, "length_mismatch"]
    assert values(spark, audio.placeholder(7, F.lit(4))) == [[7] * 4]


def test_policies(spark):
    rows = {p: tuple(values(spark, audio.contract(F.lit(1_000_000), p, 30, 1, 0, F.lit("k")))[0]) for p in audio.POLICIES}
    assert rows["skip"] == (None, None, 1_000_000, None, True) and rows["chunk_pad"] == (None, None, 1_000_000, 3, False)
    assert rows["center_crop"] == ("center_crop", 260_000, 480_000, None, False)
    assert 0 <= rows["random_crop"][1] <= 520_000
    with pytest.raises(ValueError):
        audio.contract(F.lit(1), "cut", 30, 1, 0, F.lit("k"))


def test_numbers(spark):
    assert values(spark, numbers.perplexity(F.lit(50.0)))[0] == pytest.approx(math.exp(20))
    scale = [values(spark, numbers.learning_rate_scale(F.lit(u), 10, 110, 1.0, 0.1))[0] for u in (0, 9, 10, 60, 110, 500)]
    assert scale == pytest.approx([0.1, 1.0, 1.0, 0.55, 0.1, 0.1])
    a = F.array(F.lit(3.0), F.lit(4.0))
    assert values(spark, numbers.rms(a), numbers.cosine(a, a))[0:2] == pytest.approx([math.sqrt(12.5), 1.0])
    assert values(spark, numbers.rms_norm(a, F.array(F.lit(1.0), F.lit(2.0)), 0.0))[0] == pytest.approx([3 / math.sqrt(12.5), 8 / math.sqrt(12.5)])


def test_answers(spark):
    said = ["A. yes", " \nB", "the answer is (C)", "xD.", "E", "None", "", None, "D"]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "k int, s string").orderBy("k")
    assert [r[0] for r in rows.select(text.option_letter(F.col("s"))).collect()] == ["A", "B", "C", "D", None, None, None, None, "D"]
    ratings = spark.createDataFrame([(k, s) for k, s in enumerate(["3", "4.5", "9", "Rating: [[5]]", "[[7]]", "no", None])], "k int, s string").orderBy("k")
    assert [r[0] for r in ratings.select(text.rating(F.col("s"))).collect()] == [3, 4.5, 0, 5, 0, 0, 0]
    assert tuple(values(spark, text.rubric(F.lit("CORRECTNESS: 4\nClarity: 2 - ok")))[0]) == (4, 0, 0, 2, 1.5)
    assert values(spark, text.yes_wins(F.array(*map(F.lit, ["Yes", "yes ", "No"]))), text.yes_wins(F.array(F.lit("yes"), F.lit("no")))) == [True, False]


def test_prompts(spark):
    rendered = F.lit("before <a> after")
    assert tuple(values(spark, text.around(rendered, "<a>"))[0]) == ("before ", " after") and values(spark, text.around(rendered, "<b>")) == [None]
    assert values(spark, text.leaks_instruction(rendered, "secret", "<a>"), text.leaks_instruction(rendered, "before", "<a>"), text.leaks_instruction(rendered, "secret", "<b>")) == [False, True, True]
    spans = F.array(*(F.struct(F.lit(a).alias("begin"), F.lit(b).alias("end")) for a, b in ((0, 2), (2, 5), (5, 6))))
    ids = F.array(F.lit(7), F.lit(8), F.lit(9))
    assert tuple(values(spark, text.split_ids(ids, spans, F.lit(2)))[0]) == ([7], [8, 9]) and values(spark, text.split_ids(ids, spans, F.lit(3))) == [None]
    assert values(spark, text.without_end(ids, 9), text.without_end(ids, 8)) == [[7, 8], [7, 8, 9]]
    assert values(spark, text.with_choices(F.lit(" q "), F.array(F.lit("x"), F.lit("y"))))[0].startswith("q\n\nChoices:\nA. x\nB. y\n\nRespond")
    with pytest.raises(Exception, match="blank"):
        values(spark, text.messages(("user", F.lit(" "))))
    assert text.redacted(spark.createDataFrame([(1, "k")], "a int, api_key string")).first().asDict() == {"a": 1, "api_key": "<redacted>"}


def test_revisions(spark):
    good = "a" * 40
    assert values(spark, *(hashing.is_revision(F.lit(x)) for x in (good, good.upper(), good[1:], None)), hashing.is_revision(F.lit(good.upper()), any_case=True)) == [True, False, False, False, True]

import pytest
from pyspark.sql import functions as F

from lodestream.operators import generation
from lodestream.sources import sinks
from lodestream.sources.tables import ContractError


def model(prompt, audio):
    if "bad" in prompt:
        raise RuntimeError("no answer")
    return prompt[:1] + str(len(audio)), "length" if "long" in prompt else "stop"


def test_failures_are_rows(spark):
    rows = spark.createDataFrame([(0, "a", "x", [], ["1.wav"]), (1, "b", "bad", [], None), (2, "c", "long", ["p", "q"], [])], "row_index long, sample_id string, question string, choices array<string>, audio array<string>")
    found = {r["id"]: r for r in generation.answered(generation.requests(rows, "text_question"), model).collect()}
    assert found["a"]["prediction"] == "x1" and found["c"]["truncated"] and found["b"]["error"] == "RuntimeError: no answer"
    hidden = generation.requests(rows, "audio_only").filter("id = 'a'").first()
    assert hidden["prompt"] == ""
    with pytest.raises(ContractError):
        generation.requests(rows, "other")


def test_judges_and_headers(spark):
    rows = spark.createDataFrame([(0, "q", "r", None)], "index int, question string, reference string, prediction string")
    assert generation.judge_prompts(rows, "judge").first()["messages"][1]["content"] == "Question: q\nReference: r\nAnswer: "
    made = spark.range(1).select(generation.header_metadata(F.lit(44_101.0), F.lit(44_100)).alias("m")).first()["m"]
    assert made["samples"] == 16_001 and made["chunks"] == 1


def test_paths(spark):
    files = spark.createDataFrame([("a/x.wav",), ("b/x.wav",), ("c/y.wav",)], "path string")

    def resolve(*paths):
        return {r["path"]: r["file"] for r in generation.resolved_paths(spark.createDataFrame([(p,) for p in paths], "path string"), files).collect()}

    assert resolve("a/x.wav", "y.wav", "old/y.wav") == {"a/x.wav": "a/x.wav", "y.wav": "c/y.wav", "old/y.wav": "c/y.wav"}
    for bad in ("x.wav", "z.wav", "../y.wav", "/y.wav"):
        with pytest.raises(ContractError):
            resolve(bad)


def test_differences_and_batches(spark):
    a = spark.createDataFrame([("m", "1"), ("n", None), ("o", None)], "k string, v string")
    b = spark.createDataFrame([("m", "2"), ("n", None), ("p", None)], "k string, v string")
    assert sorted(r["k"] for r in generation.differences(a, b, "k", "v").collect()) == ["m", "o", "p"]
    assert [r["batch"] for r in generation.batches(spark.range(5), "id", 2).orderBy("id").collect()] == [0, 0, 1, 1, 2]
    assert generation.length_buckets(spark.range(6).selectExpr("id", "id % 2 as n"), "n", "id").count() == 2


def test_predictions_and_content_are_kept_once(spark, tmp_path):
    rows = spark.createDataFrame([(f"a{k}", "x") for k in range(5)], "audio_id string, text string").coalesce(1)
    sinks.write_predictions(rows, str(tmp_path / "p"), "audio_id", part_rows=2)
    assert len(list((tmp_path / "p/parquet").glob("part-*"))) == 3
    with pytest.raises(ContractError, match="has a prediction"):
        sinks.write_predictions(rows, str(tmp_path / "p"), "audio_id")
    assert sinks.completed_keys(spark.read.parquet(str(tmp_path / "p/parquet")), "audio_id").count() == 5
    media = spark.createDataFrame([(1, b"x"), (2, b"x"), (3, b"y"), (4, None)], "id int, body binary")
    for _ in range(2):
        kept = sinks.keep_content(media, str(tmp_path / "c"), "body")
    assert kept.count() == 4 and spark.read.parquet(str(tmp_path / "c")).count() == 2
    assert sinks.data_uri(media.limit(1), "body").first()["uri"] == "data:audio/wav;base64,eA=="

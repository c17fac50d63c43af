import hashlib
import io
import json
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from lodestream.functions.text import SECRET_NAMES
from lodestream.operators import packing
from lodestream.sources import logs, manifests, shards, sidecars, tar
from lodestream.sources.tables import ContractError, catalog_path, scan
from lodestream.streaming.commits import commit_batch, commit_once
from lodestream.streaming.follow import follow
from lodestream.streaming.planner import end_marks, planned

from .test_functions import flac

CATALOG = "audio_id string, wds_shard string, wds_key string, flac_size long, flac_sha256 string"


@pytest.fixture
def mirror(tmp_path):
    rows = []
    for s in range(2):
        with tarfile.open(tmp_path / f"{s}.tar", "w") as archive:
            for k in range(3):
                samples = 0 if (s, k) == (1, 2) else 16_000 * (k + 1)
                payload = flac(16_000, 1, samples) + os.urandom(100 + k)
                for suffix, body in (("flac", payload), ("json", json.dumps({"audio_id": f"a{s}{k}"}).encode())):
                    info = tarfile.TarInfo(f"{'./' if k == 1 else ''}key{k}.{suffix}")
                    info.size = len(body)
                    archive.addfile(info, io.BytesIO(body))
                rows.append((f"a{s}{k}", f"{s}.tar", f"key{k}", len(payload), hashlib.sha256(payload).hexdigest()))
    return str(tmp_path), rows


def test_shards_are_indexed_counted_and_read_by_range(spark, mirror, tmp_path_factory):
    root, rows = mirror
    found = tar.members(spark, root, ["0.tar", "1.tar"])
    assert found.count() == 12 and found.rdd.getNumPartitions() == 2
    catalog = spark.createDataFrame(rows, CATALOG)
    exact = tar.exact_samples(catalog, tar.sample_index(found), spark.createDataFrame([("a12", 777)], "audio_id string, frames long"))
    counts = {r["audio_id"]: (r["num_samples"], r["num_samples_source"]) for r in exact.collect()}
    assert counts["a01"] == (32_000, "flac_streaminfo") and counts["a12"] == (777, "libsndfile_header")
    path = str(tmp_path_factory.mktemp("side") / "car")
    sidecars.write(sidecars.from_samples(exact), path, 6)
    loaded = sidecars.load(spark, path, exact=True)
    assert sidecars.usable(loaded).count() == 6
    joined = sidecars.with_durations(catalog, loaded, exact=True)
    assert joined.filter("audio_id = 'a01'").first()["duration_seconds"] == 2.0
    read = sidecars.read_payloads(joined.drop("header"), root).collect()
    assert all(hashlib.sha256(r["flac"]).hexdigest() == r["flac_sha256"] and json.loads(r["json"])["audio_id"] == r["audio_id"] for r in read) and len(read) == 6


def test_faulty_shards_have_their_own_errors(spark, mirror):
    root, rows = mirror
    index = tar.sample_index(tar.members(spark, root, ["0.tar", "1.tar"]))
    for k, (row, what) in enumerate([(("a", "0.tar", "gone", 1, "x"), "missing"), (("a", "0.tar", "key0", 1, "x"), "size")]):
        with pytest.raises(ContractError, match=what):
            tar.exact_samples(spark.createDataFrame([row], CATALOG), index)
        assert k < 2
    empty = tar.exact_samples(spark.createDataFrame(rows, CATALOG), index).filter("num_samples = 0").first()
    assert empty["num_samples_source"] == "flac_empty"


def test_stale_sidecars_are_refused(spark, mirror, tmp_path):
    _, rows = mirror
    catalog = spark.createDataFrame(rows, CATALOG).withColumn("source_id", F.col("audio_id"))
    side = sidecars.estimated(catalog, spark.createDataFrame([(r[0], 1.5) for r in rows], "source_id string, duration_seconds double"), ["source_id"])
    assert side.first()["num_samples"] == 24_000
    with pytest.raises(ContractError, match="stale"):
        sidecars.with_durations(catalog, side.withColumn("flac_sha256", F.lit("x")))
    with pytest.raises(ContractError, match="no row"):
        sidecars.with_durations(catalog, side.filter("audio_id > 'a01'"))
    with pytest.raises(ContractError, match="no duration"):
        sidecars.estimated(catalog, spark.createDataFrame([("a00", 1.0)], "source_id string, duration_seconds double"), ["source_id"])
    sidecars.write(side.union(side), str(tmp_path / "twice"))
    with pytest.raises(ContractError, match="repeats"):
        sidecars.load(spark, str(tmp_path / "twice"))
    with pytest.raises(ContractError, match="rows for"):
        sidecars.write(side, str(tmp_path / "few"), 7)


def test_mirrors_count_only_while_whole(spark, mirror):
    root, _ = mirror
    names = ["0.tar", "1.tar"]
    assert shards.complete(spark, root, "d", names) is None
    assert shards.mark(spark, root, "d", names)["shard_count"] == 2
    assert shards.complete(spark, root, "d", names) == [f"{root}/{x}" for x in names]
    assert shards.complete(spark, root, "e", names) is None and shards.complete(spark, root, "d", [*names, "2.tar"]) is None
    digests = {r["path"]: r["sha256"] for r in shards.release_manifest(spark, root, "*.tar").collect()}
    with open(f"{root}/0.tar", "rb") as file:
        assert digests["0.tar"] == hashlib.sha256(file.read()).hexdigest()
    with open(f"{root}/0.tar", "ab") as file:
        file.write(b"x")
    assert shards.complete(spark, root, "d", names) is None
    with pytest.raises(ContractError, match="1 of 3"):
        shards.mark(spark, root, "d", [*names, "2.tar"])


def test_archive_members_that_escape(spark):
    rows = spark.createDataFrame([("a/b", False), ("../a", False), ("/a", False), ("a/../../b", False), ("l", True), ("a..b", None)], "name string, is_link boolean")
    assert {r["name"]: r["safe"] for r in shards.safe_members(rows).collect()} == {"a/b": True, "../a": False, "/a": False, "a/../../b": False, "l": False, "a..b": True}


def test_manifests_are_equal_or_refused(tmp_path):
    path = str(tmp_path / "m.json")
    shards.require_same_manifest(path, {"a": 1})
    shards.require_same_manifest(path, {"a": 1})
    with pytest.raises(ContractError):
        shards.require_same_manifest(path, {"a": 2})


def test_prediction_logs(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"id": "a", "row_index": 0, "prediction": "x", "source_record": {"q": 1, "response": "old"}}\n\n{"id": "b", "error": null}\n')
    rows = logs.predictions(spark, str(log)).orderBy("line").collect()
    assert [(r["id"], r["failed"], r["row_index"]) for r in rows] == [("a", False, 0), ("b", True, None)]
    good = logs.predictions(spark, str(log)).filter("not failed")
    assert json.loads(logs.scorer_input(good, "voicebench_jsonl").first()[0]) == {"q": "1", "response": "x"}
    assert json.loads(logs.scorer_input(good, "keval_jsonl").first()[0]) == {"id": "a", "prediction": "x"}
    assert json.loads(logs.ground_truth(good).first()[0])["id"] == "a"
    with pytest.raises(ContractError):
        logs.scorer_input(good, "other")
    assert [r["line"] for r in logs.numbered(logs.lines(spark, str(log))).orderBy("line").collect()] == [0, 1]
    log.write_text("[1]\n")
    with pytest.raises(ContractError, match="no object"):
        logs.predictions(spark, str(log))


def test_scorer_logs_and_scores(spark, tmp_path):
    log = tmp_path / "out.log"
    log.write_text("Overall Accuracy: 0.1\nTotal count: 5\nOverall Accuracy: 0.25\n2024 | INFO | x - {'acc': 1, 'fail': None}\n2024 | INFO | x - {'acc': 50.5, 'panda': None}\n")
    rows = logs.lines(spark, str(log))
    assert logs.last_match(rows, r"Overall Accuracy: ([0-9.]+)", ["accuracy"]).first()["accuracy"] == "0.25"
    assert logs.last_result(rows).first()["result"] == {"acc": "50.5", "panda": None}
    for name, value, n in (("math", 0.5, 10), ("law", 0.25, 30)):
        (tmp_path / name / "scoring").mkdir(parents=True)
        (tmp_path / name / "scoring" / "scores.json").write_text(json.dumps({"aggregate_metrics": {"accuracy": {"value": value, "count": n}}}))
    tree = logs.score_tree(spark, str(tmp_path))
    assert sorted((r["subset"], r["value"], r["n"]) for r in tree.collect()) == [("law", 0.25, 30), ("math", 0.5, 10)]
    from lodestream.functions.numbers import weighted_mean

    assert tree.agg(weighted_mean(F.col("value"), F.col("n"))).first()[0] == 0.3125


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, ("s", 2))], "b int, a struct<api_key string, n int>")
    logs.append_redacted(rows, str(tmp_path / "log"))
    logs.append_redacted(rows, str(tmp_path / "log"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "log")).collect()] == ['{"a":{"api_key":"<redacted>","n":2},"b":1}'] * 2
    ids = spark.createDataFrame([("b",), ("a",)], "audio_id string")
    logs.save_ids(ids, str(tmp_path / "ids"))
    assert sorted(r[0] for r in logs.load_ids(spark, str(tmp_path / "ids")).collect()) == ["a", "b"]
    assert "key" in SECRET_NAMES


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    with pytest.raises(ContractError):
        logs.candidate_files(str(tmp_path), "s")
    (tmp_path / "s.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    assert logs.benchmark_rows(spark, logs.candidate_files(str(tmp_path), "s")).count() == 2
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "s" / "deep"))
    assert logs.benchmark_rows(spark, logs.candidate_files(str(tmp_path), "default")).count() == 3
    (tmp_path / "d.json").write_text('{"data": [{"id": "x", "duration": 1.5}, {"id": "y", "duration": 2}]}')
    assert {r["id"]: r["duration_seconds"] for r in logs.nested_durations(spark, {"one": str(tmp_path / "d.json")}).collect()} == {"x": 1.5, "y": 2.0}


SHA = "0123456789" * 4


def test_benchmark_and_profile_manifests(spark, tmp_path):
    base = {"dataset_id": "d", "revision": SHA, "split": "test", "question_mode": "audio_only", "official_format": "mmau_json", "audio_patterns": ["*"], "scorer_repo": "r", "scorer_revision": SHA}
    path = tmp_path / "b.yaml"

    def specs(**more):
        path.write_text(json.dumps({"benchmarks": {"one": base | {"subsets": ["x", "y"]} | more, "two": base}}))
        return manifests.benchmark_specs(spark, str(path))

    found = specs(judge_provider="p", judge_model="m", judge_subsets=["x"])
    assert sorted(map(tuple, manifests.selected(found, ["one:y", "two"]).collect())) == [("one", "y"), ("two", "default")]
    with pytest.raises(ContractError, match="unknown benchmark"):
        manifests.selected(found, ["one:z"])
    for more, what in (({"revision": "abc"}, "revision"), ({"judge_provider": "p"}, "in part"), ({"judge_subsets": ["z"]}, "unknown")):
        with pytest.raises(ContractError, match=what):
            specs(**more)
    path.write_text(json.dumps({"profiles": {"p": {"revision": SHA, "references": {"acc": {"expected": 1, "minimum": 0, "maximum": 2}}}}}))
    assert manifests.profile_ranges(spark, str(path)).first()["maximum"] == 2.0
    path.write_text('{"acc": 1}')
    assert manifests.score_summary(spark, str(path)).first()["value"] == 1.0


def test_configurations(tmp_path, monkeypatch):
    (tmp_path / "base.yaml").write_text("a: {x: 1, y: 2}\nkey_file: secret\n")
    (tmp_path / "own.yaml").write_text("extends: base.yaml\na: {y: 3}\nhome: ${SOME_HOME}/x\n")
    with pytest.raises(ContractError, match="SOME_HOME"):
        manifests.load_config(str(tmp_path / "own.yaml"))
    monkeypatch.setenv("SOME_HOME", "/h")
    found = manifests.load_config(str(tmp_path / "own.yaml"))
    assert found == {"a": {"x": 1, "y": 3}, "key_file": "secret", "home": "/h/x"}
    assert manifests.redacted(found)["key_file"] == "<redacted>"
    assert manifests.differing({"a": 1, "b": 2}, {"a": 1, "b": 3}, ["a", "b"]) == ["b"]


def test_catalog_layouts(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "catalog" / "d" / "audio"))
    path = catalog_path(spark, str(tmp_path), "d", "audio")
    assert scan(spark, path, ["id"]).count() == 2
    with pytest.raises(ContractError, match="none of these"):
        catalog_path(spark, str(tmp_path), "e", "audio")


def test_each_key_is_committed_once_an_epoch(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(10).write.parquet(source)

    def stream():
        return spark.readStream.schema("id long").parquet(source)

    assert commit_once(stream(), "id", 0, times=2, path=str(tmp_path / "out")).count() == 10
    spark.range(5, 15).write.mode("append").parquet(source)
    with pytest.raises(ContractError, match="5 rows have a id that is committed already"):
        commit_once(stream(), "id", 0, path=str(tmp_path / "out"))
    assert commit_once(stream(), "id", 0, path=str(tmp_path / "out")).count() == 15
    assert commit_once(stream(), "id", 1, path=str(tmp_path / "out"), duplicates="drop").count() == 15
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 30


def test_a_batch_that_runs_again_takes_its_own_place(spark, tmp_path):
    for _ in range(2):
        commit_batch(spark.range(4), 7, 0, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 4


def test_the_planner_keeps_its_buffer_between_batches(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = spark.readStream.schema("worker long, ordinal long, length long").parquet(source)
        writer = planned(stream, 10, 4).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True)
        writer.start(out).awaitTermination()

    lengths = [6, 11, 4, 5, 5, 1, 2, 3, 12, 9]
    given = spark.createDataFrame([(w, i, n) for w in (1, 2) for i, n in enumerate(lengths)], "worker long, ordinal long, length long")
    for low, high in ((0, 3), (3, 6), (6, 10)):
        given.filter(f"ordinal >= {low} and ordinal < {high}").write.mode("append").parquet(source)
        run()
    assert spark.read.parquet(out).filter("worker = 1").agg(F.max("ordinal")).first()[0] == 7
    end_marks(given).write.mode("append").parquet(source)
    run()
    rows = spark.read.parquet(out).filter("worker = 1").orderBy("ordinal").collect()
    assert rows[-1]["skipped"] == 2 and [(r["window"], r["ordinal"]) for r in rows] == [(0, 0), (0, 2), (0, 3), (1, 4), (1, 5), (1, 6), (1, 7), (2, 9)]
    batch = packing.packed(packing.windows(given.withColumnRenamed("ordinal", "given"), "worker", [F.col("given")], 4), "worker", "length", 10)
    assert sorted((r["worker"], r["window"], r["pack"], r["ordinal"]) for r in spark.read.parquet(out).collect()) == sorted((r["worker"], r["window"], r["pack"], r["ordinal"]) for r in batch.collect())


def test_following_a_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k, nll in enumerate([3.0, 2.0, 2.5]):
        (folder / f"{k}.json").write_text(json.dumps({"update": k, "nll": nll}))
    assert [r["best"] for r in follow(spark, str(folder), str(tmp_path / "s")).orderBy("update").collect()] == [3.0, 2.0, 2.0]
    (folder / "9.json").write_text(json.dumps({"update": 9, "nll": 1.0}))
    assert [r["best"] for r in follow(spark, str(folder), str(tmp_path / "s")).orderBy("update").collect()] == [3.0, 2.0, 2.0, 1.0]

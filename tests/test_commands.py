import io
import json
import tarfile

import pytest

from lodestream.commands import main
from lodestream.sources.tables import ContractError


def shout(texts):
    return [(t.upper(), "length" if len(t) > 3 else "stop", len(t)) for t in texts]


def answer(prompt, audio):
    if "bad" in prompt:
        raise ValueError("bad")
    return "B) " + audio[0], "stop"


def run(spark, capsys, *arguments):
    assert main(list(map(str, arguments)), spark) == 0
    return json.loads(capsys.readouterr().out)


def test_pack_reports(spark, capsys, tmp_path):
    spark.range(200).selectExpr("cast(id as string) audio_id", "id % 50 + 1 as length").write.parquet(str(tmp_path / "x"))
    found = run(spark, capsys, "pack-report", "--examples", tmp_path / "x", "--capacities", 40, 60, "--windows", 32)
    assert found["n_examples"] == 200 and [g["n_items"] for g in found["grid"]] == [160, 200]
    assert all(0.8 < g["utilisation"] <= 1 and g["n_packs"] >= g["lower_bound"] for g in found["grid"])
    found = run(spark, capsys, "plan-workers", "--examples", tmp_path / "x", "--capacities", 60, "--windows", 32, "--workers", 3)
    assert sum(w["n_items"] for w in found["workers"]) == 200


def test_inspection(spark, capsys, tmp_path):
    spark.createDataFrame([("a", "d", "x", 1, "s", ["dev"], 1, "k", "t"), ("b", "d", "x", 1, "s", ["train", "dev"], 1, "k", "t")], "audio_id string, dataset string, flac_sha256 string, flac_size long, source_id string, splits array<string>, target_count long, wds_key string, wds_shard string").write.parquet(str(tmp_path / "audio"))
    spark.createDataFrame([("a", "t1", "style_caption", "x", "dev", "s", "", None, None, "ok")], "audio_id string, target_id string, target_type string, text string, split string, source string, generator_model string, generator_revision string, prompt_sha256 string, review_status string").write.parquet(str(tmp_path / "targets"))
    found = run(spark, capsys, "inspect-data", "--audio", tmp_path / "audio", "--targets", tmp_path / "targets", "--splits", "dev", "train")
    assert found["n_audio"] == 2 and found["overlaps"] == [{"dev_train": 1}] and len(found["references"]) == 2


def test_scoring(spark, capsys, tmp_path):
    (tmp_path / "log").write_text('{"id": "a", "row_index": 0, "prediction": "x", "source_record": {}}\n{"id": "a", "row_index": 0, "prediction": "y", "source_record": {}}\n')
    found = run(spark, capsys, "scorer-input", "--predictions", tmp_path / "log", "--format", "keval_jsonl", "--output", tmp_path / "out")
    assert found["n_rows"] == 1 and json.loads(spark.read.text(str(tmp_path / "out")).first()[0])["prediction"] == "y"
    (tmp_path / "m" / "scoring").mkdir(parents=True)
    (tmp_path / "m" / "scoring" / "scores.json").write_text('{"aggregate_metrics": {"accuracy": {"value": 0.5, "count": 4}}}')
    assert run(spark, capsys, "summarise", "--root", tmp_path)["weighted"] == 0.5
    (tmp_path / "p.yaml").write_text(json.dumps({"profiles": {"p": {"revision": "a" * 40, "references": {"acc": {"expected": 1, "minimum": 0, "maximum": 2}, "wer": {"expected": 1, "minimum": 0, "maximum": 2}}}}}))
    (tmp_path / "s.json").write_text('{"acc": 1.5}')
    found = run(spark, capsys, "validate-reference", "--manifest", tmp_path / "p.yaml", "--profile", "p", "--scores", tmp_path / "s.json")
    assert [m["status"] for m in found["metrics"]] == ["pass", "missing"]
    assert len(run(spark, capsys, "list-profiles", "--manifest", tmp_path / "p.yaml")["profiles"]) == 2


def test_expanding_and_generating(spark, capsys, tmp_path):
    spark.createDataFrame([(f"a{k}", f"t{k}", "caption", f" text {k} "[k % 2 :], "dev") for k in range(5)], "audio_id string, target_id string, target_type string, text string, split string").write.parquet(str(tmp_path / "targets"))
    own = ["expand-responses", "--targets", tmp_path / "targets", "--output", tmp_path / "overlay", "--model", "tests.test_commands:shout", "--types", "caption", "--setting", "t=1"]
    assert run(spark, capsys, *own, "--limit", 2)["n_rows"] == 2
    found = run(spark, capsys, *own)
    assert found["n_rows"] == found["n_truncated"] == 5 and run(spark, capsys, *own)["recipe_sha256"] == found["recipe_sha256"]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "test.jsonl").write_text("".join(json.dumps({"id": str(k), "question": "bad" if k == 1 else "q", "choices": ["x", "y"], "audio": [f"{k}.wav"]}) + "\n" for k in range(4)))
    own = ["generate", "--root", tmp_path / "b", "--subset", "test", "--model", "tests.test_commands:answer", "--output", tmp_path / "out"]
    found = run(spark, capsys, *own)
    assert (found["n_asked"], found["n_answered"], found["errors"]) == (4, 3, [{"error": "ValueError: bad", "n_rows": 1}])
    assert run(spark, capsys, *own)["n_asked"] == 1
    spark.createDataFrame([("0", "B"), ("1", "B"), ("2", "A"), ("3", "B")], "id string, answer string").write.parquet(str(tmp_path / "answers"))
    found = run(spark, capsys, "score", "--predictions", tmp_path / "out" / "json", "--answers", tmp_path / "answers")
    assert found == {"accuracy": 0.5, "n_rows": 4, "n_lacking": 1, "n_unparsed": 0}


def test_checks_and_archives(spark, capsys, tmp_path):
    spark.createDataFrame([("r", 10.0, 100, 5), ("s", 700.0, 100, 5)], "request string, seconds double, tokens long, words long").write.parquet(str(tmp_path / "items"))
    found = run(spark, capsys, "preflight", "--items", tmp_path / "items")
    assert found == {"n_requests": 2, "faults": [{"rule": "seconds", "n_requests": 1}]}
    spark.range(50).selectExpr("cast(id as string) audio_id", "id % 9 + 1 as length").write.parquet(str(tmp_path / "x"))
    assert run(spark, capsys, "check-packing", "--examples", tmp_path / "x", "--capacities", 12, "--windows", 8)["faults"] == {"too_full": 0, "lost": 0}
    for name, safe in (("a/b.txt", True), ("../c.txt", False)):
        with tarfile.open(tmp_path / "x.tar", "w") as archive:
            info = tarfile.TarInfo(name)
            info.size = 1
            archive.addfile(info, io.BytesIO(b"x"))
        if safe:
            assert run(spark, capsys, "unpack", "--archive", tmp_path / "x.tar", "--output", tmp_path / "un")["n_members"] == 1
            assert (tmp_path / "un/a/b.txt").read_text() == "x"
        else:
            with pytest.raises(ContractError, match="may not be unpacked"):
                main(["unpack", "--archive", str(tmp_path / "x.tar"), "--output", str(tmp_path / "un")], spark)
    assert not (tmp_path / "c.txt").exists()


def test_settings_releases_and_plans(spark, capsys, tmp_path):
    (tmp_path / "c.yaml").write_text(json.dumps({"data": {"num_workers": 0, "api_token": "x"}, "prompt": {"prompt_file": "p"}}))
    found = run(spark, capsys, "check-settings", "--config", tmp_path / "c.yaml")
    assert found["broken"] == ["workers_persist", "workers_for_whisper"] and found["settings"]["data"]["api_token"] == "<redacted>"
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.txt").write_text("abc")
    assert run(spark, capsys, "stage-release", "--root", tmp_path / "r", "--output", tmp_path / "m.json") == {"file_count": 1, "total_bytes": 3}
    assert json.loads((tmp_path / "m.json").read_text())["files"][0]["path"] == "a.txt"
    (tmp_path / "v").mkdir()
    (tmp_path / "v" / "1.json").write_text('{"update": 1, "nll": 2.0}')
    assert run(spark, capsys, "watch-validation", "--folder", tmp_path / "v", "--state", tmp_path / "s")["results"] == [{"update": 1, "nll": 2.0, "best": 2.0}]
    spec = {"dataset_id": "x/y", "revision": "a" * 40, "split": "test", "question_mode": "audio_only", "official_format": "f", "audio_patterns": [], "scorer_repo": "r", "scorer_revision": "b" * 40}
    (tmp_path / "m.yaml").write_text(json.dumps({"benchmarks": {"one": spec}}))
    found = run(spark, capsys, "plan-scoring", "--manifest", tmp_path / "m.yaml", "--benchmarks", "one", "--commands", "f=run it")
    assert found["commands"] == [{"name": "one", "subset": "default", "official_format": "f", "command": "run it"}]

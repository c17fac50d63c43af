"""Commands: python -m lodestream COMMAND ... prints one JSON object.

Commands that train, serve or download models have no counterpart here; those that only read tables, plan packs, score and
summarise do.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import tarfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.hashing import order_key, stable_bucket
from .functions.numbers import full_mean, weighted_mean
from .functions.text import option_letter
from .operators import catalog, dispatch, evaluation, generation, metrics, ordering, overlay, packing, settings, validation
from .sources import logs, manifests, shards, sidecars, sinks, tar
from .sources.tables import ContractError, exists, scan, store
from .streaming.follow import follow


def _rows(df: DataFrame) -> list[dict]:
    """All rows of what is small by its nature: reports, specifications, histograms."""
    return [r.asDict(recursive=True) for r in df.collect()]


def inspect_data(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Counts of a catalog: splits, review states, references and durations."""
    audio = catalog.audio_rows(spark.read.parquet(a.audio))
    targets = catalog.target_rows(spark.read.parquet(a.targets))
    validation.require_unique(audio, "audio_id")
    validation.require_unique(targets, "target_id")
    chosen = audio.filter(catalog.in_splits("splits", a.splits))
    nested = catalog.nested_index(chosen, targets, "audio_id", "target_id", F.col("target_type"), a.captions, a.transcript, "text")
    out = {
        "n_audio": chosen.count(),
        "review_status": _rows(catalog.histogram(targets, F.col("review_status"), "status")),
        "references": _rows(catalog.histogram(nested, F.size("captions"), "n_captions")),
        "overlaps": _rows(validation.overlaps(audio, "splits", [(x, y) for k, x in enumerate(a.splits) for y in a.splits[k + 1 :]])) if len(a.splits) > 1 else [],
    }
    if a.sidecar:
        timed = sidecars.with_durations(chosen, sidecars.load(spark, a.sidecar))
        out["durations"] = _rows(metrics.exact_quantiles(timed, "duration_seconds", [0.0, 0.5, 0.9, 0.99, 1.0], "floor"))
    return out


def pack_report(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Packs of examples (audio_id, length) by window sizes and capacities, rows that are too long left out first."""
    rows = scan(spark, a.examples, ["audio_id", "length"])
    order = [order_key(a.seed, a.epoch, F.col("audio_id")), F.col("audio_id")]
    grid = _rows(packing.grid(rows, order, "length", a.capacities, a.windows).withColumnRenamed("size", "window").orderBy("capacity", "window"))
    quantiles = metrics.exact_quantiles(rows, "length", [0.5, 0.9, 0.95, 0.99, 1.0])
    return {"n_examples": rows.count(), "quantiles": _rows(quantiles), "grid": grid}


def plan_workers(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Packs of each worker's stream, and of all of them."""
    rows = scan(spark, a.examples, ["audio_id", "length"])
    rows = rows.withColumn("worker", stable_bucket(a.seed, a.epoch, F.col("audio_id"), a.workers))
    placed = packing.windows(rows, "worker", [F.col("audio_id")], a.windows[0])
    packs = packing.packed(placed, "worker", "length", a.capacities[0], oversized=a.oversized)
    stats = packing.pack_stats(packs, ["worker"], "worker", "length", a.capacities[0], placed)
    return {"workers": _rows(stats.orderBy("worker")), "total": _rows(packing.merge_stats(stats, [], F.lit(a.capacities[0])))}


def build_sidecar(spark: SparkSession, a: argparse.Namespace) -> dict:
    """An exact sidecar from the headers in local shards."""
    audio = scan(spark, a.audio, ["audio_id", "wds_shard", "wds_key", "flac_size", "flac_sha256"])
    names = [r[0] for r in audio.select("wds_shard").distinct().orderBy("wds_shard").collect()]  # shards, not samples
    exact = tar.exact_samples(audio, tar.sample_index(tar.members(spark, a.root, names))).drop("header")
    sidecars.write(sidecars.from_samples(exact), a.output, audio.count())
    return {"n_shards": len(names), "output": a.output}


def mark_mirror(spark: SparkSession, a: argparse.Namespace) -> dict:
    names = [r[0] for r in scan(spark, a.audio, ["wds_shard"]).distinct().collect()]
    made = shards.mark(spark, a.root, a.dataset, names)
    return {k: made[k] for k in ("shard_count", "total_bytes")}


def list_benchmarks(spark: SparkSession, a: argparse.Namespace) -> dict:
    return {"benchmarks": _rows(manifests.benchmark_specs(spark, a.manifest).orderBy("name"))}


def list_profiles(spark: SparkSession, a: argparse.Namespace) -> dict:
    return {"profiles": _rows(manifests.profile_ranges(spark, a.manifest).orderBy("profile", "metric"))}


def validate_reference(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A summary's scores against a profile's ranges."""
    profile = manifests.profile_ranges(spark, a.manifest).filter(F.col("profile") == a.profile)
    return {"metrics": _rows(metrics.range_check(manifests.score_summary(spark, a.scores), profile).orderBy("metric"))}


def scorer_input(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The file that a scorer takes, of a log's last predictions."""
    good = logs.predictions(spark, a.predictions).filter("not failed")
    kept = evaluation.last_wins(good, evaluation.prediction_key(F.col("row_index"), F.col("id"), a.by_id), "line", ["id", "prediction", "source_record"])
    logs.write_lines(logs.scorer_input(kept, a.format, a.subset), a.output)
    return {"output": a.output, "n_rows": kept.count()}


def summarise(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Scores below a folder and their mean weighted by counts."""
    tree = logs.score_tree(spark, a.root).filter(F.col("metric") == a.metric)
    total = tree.agg(weighted_mean(F.col("value"), F.col("n")).alias("weighted"), F.sum("n").alias("n"))
    return {"subsets": _rows(tree.orderBy("subset")), **_rows(total)[0]}


def _named(name: str):
    """A function written module:name."""
    module, _, own = name.partition(":")
    return getattr(importlib.import_module(module), own)


def expand_responses(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Texts of a model (module:function) for what an overlay lacks of a catalog's targets."""
    targets = overlay.source_targets(spark.read.parquet(a.targets), a.types)
    recipe = overlay.recipe_hash(model=a.model, types=sorted(set(a.types)), **dict(x.split("=", 1) for x in a.setting))
    rows = overlay.expand(targets, _named(a.model), a.output, recipe, a.limit)
    counts = rows.agg(F.count("*").alias("n_rows"), F.count_if("truncated").alias("n_truncated"))
    return {"recipe_sha256": recipe, **_rows(counts)[0]}


def generate(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Predictions of a model (module:function) for the rows of a benchmark that have none; failures are counted and tried again."""
    rows = ordering.with_position(evaluation.normalised(logs.benchmark_rows(spark, logs.candidate_files(a.root, a.subset))), [F.col("sample_id"), F.col("source_record")], "row_index")
    asked = generation.requests(rows, a.mode)
    if exists(spark, f"{a.output}/parquet"):
        done = sinks.completed_keys(spark.read.parquet(f"{a.output}/parquet"), "row_index")
        asked = evaluation.pending(asked, done, "row_index")
    made = store(generation.answered(asked, _named(a.model)), "answers")
    good = made.filter("error is null").drop("error")
    sinks.write_predictions(good, a.output, "row_index")
    return {"n_asked": made.count(), "n_answered": good.count(), "errors": _rows(made.filter("error is not null").groupBy("error").agg(F.count("*").alias("n_rows")).orderBy("error"))}


def preflight(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Requests whose items (request, seconds, tokens, words) break a limit of the context."""
    items = scan(spark, a.items, ["request", "seconds", "tokens", "words"])
    found = evaluation.context_faults(items, "request", a.most_items, a.most_seconds, a.reserve, a.max_output, a.model_length)
    return {"n_requests": items.select("request").distinct().count(), "faults": _rows(found.groupBy("rule").agg(F.count("*").alias("n_requests")).orderBy("rule"))}


def unpack(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The members of an archive below a folder; a link, or a name that leads out of it, is an error before anything is written."""
    with tarfile.open(a.archive) as archive:
        found = archive.getmembers()
        names = spark.createDataFrame([(x.name, x.issym() or x.islnk()) for x in found], "name string, is_link boolean")
        if bad := shards.safe_members(names).filter("not safe").head(1):
            raise ContractError(f"the member {bad[0]['name']} may not be unpacked")
        archive.extractall(a.output, filter="data")
    return {"n_members": len(found), "output": a.output}


def check_packing(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Packs of examples, and whether each holds no more than it may and each example lies in one of them."""
    rows = scan(spark, a.examples, ["audio_id", "length"]).withColumn("worker", F.lit(0))
    packs = packing.packed(packing.windows(rows, "worker", [F.col("audio_id")], a.windows[0]), "worker", "length", a.capacities[0])
    full = packs.groupBy("window", "pack").agg(F.sum("length").alias("used"))
    faults = {"too_full": full.filter(F.col("used") > a.capacities[0]).count(), "lost": rows.filter(F.col("length") <= a.capacities[0]).count() - packs.select("audio_id").distinct().count()}
    return {"faults": faults, "n_packs": full.count()}


def score(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Share of all rows whose prediction names the right letter (answers: id, answer); an unusable prediction is wrong."""
    good = logs.predictions(spark, a.predictions).filter("not failed")
    kept = evaluation.last_wins(good, evaluation.prediction_key(F.col("row_index"), F.col("id"), True), "line", ["id", "prediction"])
    answers = scan(spark, a.answers, ["id", "answer"])
    joined = answers.join(kept, "id", "left").select((option_letter(F.col("prediction")) == F.col("answer")).alias("right"), F.col("prediction").isNull().alias("lacking"))
    return _rows(joined.agg(full_mean(F.col("right").cast("int")).alias("accuracy"), F.count("*").alias("n_rows"), F.count_if("lacking").alias("n_lacking"), F.count_if(F.col("right").isNull() & ~F.col("lacking")).alias("n_unparsed")))[0]


def check_settings(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The rules that a training or a runtime configuration breaks, and the configuration without its secrets."""
    found = manifests.load_config(a.config)
    return {"broken": settings.broken(found, {"training": settings.TRAINING, "runtime": settings.RUNTIME}[a.kind]), "settings": manifests.redacted(found)}


def stage_release(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Sizes and digests of the files of a release, written beside them."""
    files = _rows(shards.release_manifest(spark, a.root, a.pattern).orderBy("path"))
    out = {"files": files, "file_count": len(files), "total_bytes": sum(x["n_bytes"] for x in files)}
    shards.write_json(a.output, out)
    return {k: out[k] for k in ("file_count", "total_bytes")}


def watch_validation(spark: SparkSession, a: argparse.Namespace) -> dict:
    """What a folder of validation results holds so far, read where the last look ended."""
    rows = follow(spark, a.folder, a.state)
    return {"results": _rows(rows.orderBy("update"))}


def plan_scoring(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The command that scores each subset of the chosen benchmarks (formats as format=command)."""
    specs = manifests.benchmark_specs(spark, a.manifest)
    kinds = dict(x.split("=", 1) for x in a.commands)
    return {"commands": _rows(dispatch.scorer_commands(specs, kinds).join(manifests.selected(specs, a.benchmarks), ["name", "subset"]).orderBy("name", "subset"))}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodestream", description=__doc__)
    kinds = out.add_subparsers(dest="command", required=True)

    def command(f, *required: str, **more):
        own = kinds.add_parser(f.__name__.replace("_", "-"), help=(f.__doc__ or "").split("\n")[0])
        own.set_defaults(run=f)
        for x in required:
            own.add_argument(f"--{x}", required=True)
        for x, options in more.items():
            own.add_argument(f"--{x.replace('_', '-')}", **options)

    plan = {"seed": {"type": int, "default": 1337}, "epoch": {"type": int, "default": 0}, "capacities": {"type": int, "nargs": "+", "default": [4096, 8192, 12288, 16384, 24576, 32768]}, "windows": {"type": int, "nargs": "+", "default": [256, 512, 1024, 2048, 4096]}}
    command(inspect_data, "audio", "targets", splits={"nargs": "+", "required": True}, captions={"default": "style_caption"}, transcript={"default": "transcription"}, sidecar={})
    command(pack_report, "examples", **plan)
    command(plan_workers, "examples", **plan, workers={"type": int, "default": 2}, oversized={"choices": ["skip", "error"], "default": "skip"})
    command(build_sidecar, "audio", "root", "output")
    command(mark_mirror, "audio", "root", "dataset")
    command(list_benchmarks, "manifest")
    command(list_profiles, "manifest")
    command(validate_reference, "manifest", "profile", "scores")
    command(scorer_input, "predictions", "format", "output", subset={"default": ""}, by_id={"action": "store_true"})
    command(expand_responses, "targets", "output", "model", types={"nargs": "+", "required": True}, setting={"nargs": "*", "default": []}, limit={"type": int})
    command(generate, "root", "model", "output", subset={"default": "default"}, mode={"choices": ["text_question", "audio_only"], "default": "text_question"})
    limits = {"most_items": 3, "reserve": 0, "max_output": 1024, "model_length": 32768}
    command(preflight, "items", most_seconds={"type": float, "default": 600.0}, **{k: {"type": int, "default": v} for k, v in limits.items()})
    command(unpack, "archive", "output")
    command(check_packing, "examples", **plan)
    command(score, "predictions", "answers")
    command(check_settings, "config", kind={"choices": ["training", "runtime"], "default": "training"})
    command(stage_release, "root", "output", pattern={"default": "*"})
    command(watch_validation, "folder", "state")
    command(plan_scoring, "manifest", benchmarks={"nargs": "+", "required": True}, commands={"nargs": "+", "required": True})
    command(summarise, "root", metric={"default": "accuracy"})
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    session = spark or SparkSession.builder.getOrCreate()
    json.dump(a.run(session, a), sys.stdout, indent=2, sort_keys=True, default=str)
    print()
    return 0

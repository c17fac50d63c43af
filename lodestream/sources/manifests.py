"""Benchmark and profile manifests (YAML) as small tables, and configurations with inheritance."""

from __future__ import annotations

import json
import os
import re

import yaml
from pyspark.sql import DataFrame, SparkSession

from ..functions.text import REDACTED, SECRET_NAMES
from .tables import ContractError

_REVISION = re.compile("[0-9a-f]{40}")
_VARIABLE = re.compile(r"\$\{(?:ENV:)?([A-Za-z_][A-Za-z0-9_]*)\}")
_SPEC = "name string, dataset_id string, revision string, subsets array<string>, split string, question_mode string, official_format string, audio_patterns array<string>, scorer_repo string, scorer_revision string, supports_multiple_audio boolean, judge_provider string, judge_model string, judge_subsets array<string>"


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        found = yaml.safe_load(file)
    if not isinstance(found, dict):
        raise ContractError(f"{path} is no mapping")
    return found


def _pinned(value: object, what: str) -> str:
    if not _REVISION.fullmatch(str(value)):
        raise ContractError(f"{what} is no full revision: {value}")
    return str(value)


def benchmark_specs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each benchmark; revisions are full, judges whole and their subsets known."""
    rows = []
    for name, own in (_read(path).get("benchmarks") or {}).items():
        subsets, judged = list(map(str, own.get("subsets", ["default"]))), list(map(str, own.get("judge_subsets", [])))
        if bool(own.get("judge_provider")) != bool(own.get("judge_model")):
            raise ContractError(f"{name} names a judge in part")
        if not set(judged) <= set(subsets):
            raise ContractError(f"{name} has unknown judged subsets: {sorted(set(judged) - set(subsets))}")
        rows.append((name, str(own["dataset_id"]), _pinned(own["revision"], f"{name}'s data"), subsets, str(own["split"]), str(own["question_mode"]), str(own["official_format"]), list(map(str, own["audio_patterns"])), str(own["scorer_repo"]), _pinned(own["scorer_revision"], f"{name}'s scorer"), bool(own.get("supports_multiple_audio", False)), own.get("judge_provider"), own.get("judge_model"), judged))
    if not rows:
        raise ContractError(f"{path} names no benchmarks")
    return spark.createDataFrame(rows, _SPEC)


def selected(specs: DataFrame, wanted: list[str]) -> DataFrame:
    """name and subset of the benchmarks wanted, each written as name or name:subset."""
    pairs = [(x.partition(":")[0], x.partition(":")[2] or None) for x in wanted]
    asked = specs.sparkSession.createDataFrame(pairs, "name string, asked string")
    each = specs.selectExpr("name", "explode(subsets) as subset").join(asked, "name").filter("asked is null or asked = subset").select("name", "subset").distinct()
    known = {(r["name"], s) for r in specs.select("name", "subsets").collect() for s in [None, *r["subsets"]]}
    if odd := [x for x in pairs if x not in known]:
        raise ContractError(f"unknown benchmark {odd[0]}")
    return each


def profile_ranges(spark: SparkSession, path: str) -> DataFrame:
    """profile, revision, metric, expected, minimum and maximum."""
    rows = []
    for name, own in (_read(path).get("profiles") or {}).items():
        revision = _pinned(own["revision"], name)
        rows += [(name, revision, m, *(float(v[k]) for k in ("expected", "minimum", "maximum"))) for m, v in own.get("references", {}).items()]
    return spark.createDataFrame(rows, "profile string, revision string, metric string, expected double, minimum double, maximum double")


def score_summary(spark: SparkSession, path: str) -> DataFrame:
    """metric and value of a JSON object of numbers."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    if not isinstance(found, dict):
        raise ContractError(f"{path} is no object")
    return spark.createDataFrame([(str(k), float(v)) for k, v in found.items()], "metric string, value double")


def merged(base: dict, over: dict) -> dict:
    """base with over's entries, mappings entry by entry."""
    return {**base, **{k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}


def _each_text(value: object, f) -> object:
    if isinstance(value, dict):
        return {k: _each_text(v, f) for k, v in value.items()}
    if isinstance(value, list):
        return [_each_text(v, f) for v in value]
    return f(value) if isinstance(value, str) else value


def expanded(value: object) -> object:
    """value with environment variables put in; one that isn't set is an error."""

    def one(text: str) -> str:
        if lacking := [x for x in _VARIABLE.findall(text) if x not in os.environ]:
            raise ContractError(f"environment variable {lacking[0]} isn't set")
        return _VARIABLE.sub(lambda m: os.environ[m[1]], text)

    return _each_text(value, one)


def load_config(path: str) -> dict:
    """A configuration over the one that it extends, which extends none."""
    own = _read(path)
    if (base := own.pop("extends", None)) is not None:
        below = _read(os.path.join(os.path.dirname(os.path.abspath(path)), str(base)))
        if "extends" in below:
            raise ContractError("a configuration may extend one that extends none")
        own = merged(below, own)
    return expanded(own)


def redacted(value: object, name: str = "") -> object:
    """value with the entries of names that speak of secrets blotted out."""
    if any(x in name.lower() for x in SECRET_NAMES):
        return REDACTED
    if isinstance(value, dict):
        return {k: redacted(v, str(k)) for k, v in value.items()}
    return [redacted(v, name) for v in value] if isinstance(value, list) else value


def differing(saved: dict, now: dict, keys: list[str]) -> list[str]:
    """Those of keys that two manifests have otherwise."""
    return [k for k in keys if saved.get(k) != now.get(k)]

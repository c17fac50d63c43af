"""Settings that must fit each other: each check returns the rules that are broken, and require_settings() raises for the first."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import ContractError, exists

_DIGEST, _REVISION = re.compile("[0-9a-fA-F]{64}"), re.compile("[0-9a-f]{40}")
# Providers of targets, and the modes of prompts that go with expanded ones and with plain ones.
EXPANDED_PROVIDER, EXPANDED_MODE = "caption_expansion_overlay", "caption_expansion_alignment"

Rules = dict[str, Callable[[dict], bool]]


def _at(settings: dict, path: str, otherwise: object = None) -> object:
    """The entry at a dotted path."""
    for name in path.split("."):
        if not isinstance(settings, dict) or name not in settings:
            return otherwise
        settings = settings[name]
    return settings


def _unique(values: Iterable | None) -> bool:
    values = list(values or [])
    return len(values) == len(set(values))


def _sources(s: dict) -> list[dict]:
    return _at(s, "data.training_sources") or []


def _expanded(s: dict) -> bool:
    return _at(s, "data.target_provider", "official_target") == EXPANDED_PROVIDER


def _whole_recipe(x: dict) -> bool:
    return bool(x.get("expansion_decoder_lock")) and bool(_DIGEST.fullmatch(str(x.get("expansion_recipe_sha256") or "")))


def _chunked(s: dict) -> bool:
    return _at(s, "data.long_audio_policy", "skip") == "chunk_pad"


def _compiled(s: dict) -> bool:
    return bool(_at(s, "optimization.torch_compile")) and bool(_at(s, "optimization.compile_whisper_encoder"))


#: Rules across the sections of a training configuration; each says what is right.
TRAINING: Rules = {
    "sources_unique": lambda s: _unique(x.get("dataset") for x in _sources(s)),
    "source_splits": lambda s: all(x.get("splits") and _unique(x["splits"]) for x in _sources(s)),
    "workers_persist": lambda s: _at(s, "data.num_workers", 2) > 0 or not _at(s, "data.persistent_workers", True),
    "workers_for_whisper": lambda s: _at(s, "frontend.kind", "whisper") != "whisper" or _at(s, "data.num_workers", 2) > 0,
    "sample_limit": lambda s: (_at(s, "packing.max_sample_lfm_tokens") or 0) <= _at(s, "packing.max_lfm_tokens", 0) or not _at(s, "packing.max_sample_lfm_tokens"),
    "expansion_together": lambda s: _expanded(s) == (_at(s, "prompt.mode") == EXPANDED_MODE),
    "expansion_recipe": lambda s: not _expanded(s) or all(map(_whole_recipe, [_at(s, "data") or {}, *_sources(s)])),
    "expansion_prompt": lambda s: _at(s, "prompt.mode") != EXPANDED_MODE or (_at(s, "prompt.system_message") is None and bool(_at(s, "prompt.require_no_system_message")) and _at(s, "prompt.user_content") == "audio_sentinel_only" and _at(s, "prompt.prompt_file") is None),
    "plain_prompt": lambda s: _at(s, "prompt.mode") == EXPANDED_MODE or (_at(s, "prompt.prompt_file") is not None and _at(s, "prompt.user_content", "prompt_file") == "prompt_file"),
    "chunks_together": lambda s: _chunked(s) == bool(_at(s, "frontend.chunk_long_audio")),
    "chunk_seconds": lambda s: not _chunked(s) or _at(s, "data.max_audio_seconds", 30.0) == _at(s, "frontend.max_seconds", 30.0),
    "compiled_shapes": lambda s: not _compiled(s) or _at(s, "frontend.kind", "whisper") != "whisper" or _at(s, "frontend.mode") == "official_fixed_30s",
}

#: Rules between the server and its client.
RUNTIME: Rules = {
    "model_length": lambda s: _at(s, "client.max_model_len") is not None and int(_at(s, "client.max_model_len")) == _at(s, "server.max_model_len"),
    "audio_limit": lambda s: _at(s, "server.audio_limit", 0) >= 3,
    "audio_seconds": lambda s: _at(s, "client.max_audio_seconds") is not None and float(_at(s, "client.max_audio_seconds")) == _at(s, "server.max_audio_decode_duration_seconds"),
}


def export_rules(model_type: str, architecture: str) -> Rules:
    """Rules of an exported model's configuration."""
    return {
        "model_type": lambda s: s.get("model_type") == model_type,
        "architecture": lambda s: s.get("architectures") == [architecture],
        "tokenizer_size": lambda s: (s.get("text_tokenizer_size") or 0) > 0,
        "audio_token": lambda s: (s.get("audio_token_index") or 0) >= (s.get("text_tokenizer_size") or 0),
        "revisions": lambda s: all(_REVISION.fullmatch(str(s.get(x) or "")) for x in ("text_model_revision", "audio_model_revision")),
    }


def split_rules(dataset: str, splits: tuple[str, str, str], forbidden: tuple[str, ...]) -> Rules:
    """Rules of a dataset whose three splits are fixed and some of whose splits must not be used."""

    def used(s: dict) -> tuple:
        return tuple(_at(s, f"data.{x}_split") for x in ("train", "validation", "final"))

    def own(s: dict) -> bool:
        return str(_at(s, "data.dataset", "")).startswith(dataset)

    return {
        "forbidden_split": lambda s: not own(s) or not set(forbidden) & set(used(s)),
        "fixed_splits": lambda s: not own(s) or used(s) == splits,
    }


def broken(settings: dict, rules: Rules) -> list[str]:
    """Names of the rules that settings break, in their order."""
    return [name for name, holds in rules.items() if not holds(settings)]


def require_settings(settings: dict, rules: Rules) -> dict:
    if found := broken(settings, rules):
        raise ContractError(f"the settings break the rule {found[0]}")
    return settings


def require_source(spark: SparkSession, provider: str, providers: Iterable[str], splits: list[str], overlay: str | None = None) -> None:
    """Raises unless a catalog's source can be read: a known provider, some splits, and an overlay that exists if one is named."""
    if provider not in set(providers):
        raise ContractError(f"unknown provider of targets: {provider}")
    if not splits:
        raise ContractError("no split is given")
    if overlay is not None and not exists(spark, overlay):
        raise ContractError(f"the overlay {overlay} isn't there")


def require_split(split: str, forbidden: Iterable[str], guarded: Iterable[str], allow_guarded: bool = False) -> str:
    """split, unless it must never be read or, being guarded, isn't allowed for this run."""
    if split in set(forbidden):
        raise ContractError(f"the split {split} must not be read")
    if split in set(guarded) and not allow_guarded:
        raise ContractError(f"the split {split} is read only where that is allowed by name")
    return split


def outside(values: Column, allowed: Iterable[str]) -> Column:
    """Those of an array's values that an enumeration lacks: empty where it is a subset."""
    return F.array_except(values, F.array(*(F.lit(x) for x in allowed)))


def mapped_names(weights: DataFrame, name: str, prefix: str, to: str) -> DataFrame:
    """weights (name, ...) with the name that each has in an export; one of another prefix, or two of one new name, is an error."""
    if bad := weights.filter(~F.coalesce(F.col(name).startswith(prefix), F.lit(False))).head(1):
        raise ContractError(f"unexpected weight {bad[0][name]}")
    out = weights.withColumn("mapped", F.concat(F.lit(to), F.substring(F.col(name), len(prefix) + 1, 1 << 30)))
    if bad := out.groupBy("mapped").count().filter("count > 1").head(1):
        raise ContractError(f"two weights are mapped to {bad[0]['mapped']}")
    if out.isEmpty():
        raise ContractError("there are no weights")
    return out

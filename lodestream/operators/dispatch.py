"""What is chosen by name: datasets' readers, tokenizers, frontends and scorers' commands."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import audio, text
from ..sources.tables import ContractError

Backend = Callable[[DataFrame], DataFrame]

#: Lengths of texts by tokenizer, and frames of samples by frontend; more can be put in.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"words": text.words, "characters": lambda x: F.coalesce(F.length(x), F.lit(0)).cast("long")}
FRONTENDS: dict[str, Callable[[Column, int], Column]] = {
    "whisper": lambda samples, stack: audio.projected_tokens(audio.chunked_encoder_frames(samples), stack),
    "dmel": lambda samples, stack: audio.projected_tokens(audio.dmel_frames(samples, 160 * stack), 1),
}


def chosen(kinds: dict[str, object], name: str, what: str) -> object:
    if name not in kinds:
        raise ContractError(f"unknown {what} {name}; there are {', '.join(sorted(kinds))}")
    return kinds[name]


def by_backend(rows: DataFrame, dataset: str, backends: dict[str, Backend]) -> DataFrame:
    """Each row through the backend of its dataset; a dataset without one is an error."""
    if odd := rows.filter(~F.coalesce(F.col(dataset).isin(*backends), F.lit(False))).select(dataset).head(1):
        raise ContractError(f"no backend for dataset {odd[0][0]}")
    parts = [make(rows.filter(F.col(dataset) == name)) for name, make in sorted(backends.items())]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def packable(rows: DataFrame, key: str, texts: dict[str, Column], samples: Column, tokenizer: str, frontend: str, stack: int = 4) -> DataFrame:
    """key and length of rows as examples: texts before, after and target by a tokenizer, audio by a frontend."""
    count = chosen(TOKENIZERS, tokenizer, "tokenizer")
    frames = chosen(FRONTENDS, frontend, "frontend")
    n = {k: count(texts[k]) if k in texts else F.lit(0).cast("long") for k in ("before", "after", "target")}
    return rows.select(key, audio.example_length(n["before"], frames(samples, stack), n["after"], n["target"]).cast("long").alias("length"))


def scorer_commands(specs: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """name, subset, official_format and command of benchmarks' subsets; a format without a command is an error."""
    each = specs.select("name", F.explode("subsets").alias("subset"), "official_format")
    known = specs.sparkSession.createDataFrame(sorted(kinds.items()), "official_format string, command string")
    out = each.join(F.broadcast(known), "official_format", "left")
    if odd := out.filter("command is null").head(1):
        raise ContractError(f"no scorer takes {odd[0]['official_format']}")
    return out.select("name", "subset", "official_format", "command")

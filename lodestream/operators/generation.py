"""Answers of a pluggable model to benchmark rows, judges' conversations, and how their inputs are found and compared."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.audio import at_rate, chunk_count
from ..functions.text import with_choices
from ..sources.tables import ContractError

_ANSWER = "row_index long, id string, prediction string, finish_reason string, truncated boolean, error string"

Model = Callable[[str, list[str]], tuple[str, str]]


def requests(rows: DataFrame, mode: str) -> DataFrame:
    """row_index, id, prompt and audio of normalised rows (row_index, sample_id, question, choices, audio).

    Only text questions show the question and its choices.
    """
    if mode not in ("text_question", "audio_only"):
        raise ContractError(f"unknown mode: {mode}")
    prompt = with_choices(F.col("question"), F.col("choices")) if mode == "text_question" else F.lit("")
    return rows.select("row_index", F.col("sample_id").alias("id"), prompt.alias("prompt"), "audio")


def answered(asked: DataFrame, model: Model) -> DataFrame:
    """A row for each request: its prediction, or the error that the model raised for it alone."""

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                try:
                    text, reason = model(row.prompt, list(row.audio) if row.audio is not None else [])
                    out.append((row.row_index, row.id, text, reason, reason == "length", None))
                except Exception as error:  # noqa: BLE001  one request's failure is that request's row
                    out.append((row.row_index, row.id, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in _ANSWER.split(", ")])

    return asked.mapInPandas(parts, _ANSWER)


def judge_prompts(rows: DataFrame, instruction: str) -> DataFrame:
    """index and messages for a judge of rows (index, question, reference, prediction)."""
    asked = F.concat(F.lit("Question: "), F.col("question"), F.lit("\nReference: "), F.col("reference"), F.lit("\nAnswer: "), F.coalesce("prediction", F.lit("")))
    chat = F.array(F.struct(F.lit("system").alias("role"), F.lit(instruction).alias("content")), F.struct(F.lit("user").alias("role"), asked.alias("content")))
    return rows.select("index", chat.alias("messages"))


def header_metadata(frames: Column, rate: Column) -> Column:
    """samples at the common rate, seconds and chunks of audio by its header."""
    return F.struct(at_rate(frames, rate).alias("samples"), (frames / rate).alias("seconds"), chunk_count(frames / rate).alias("chunks"))


def resolved_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (path) with file: the listed file of that path, else the only one of that name.

    Paths that leave the root, names of several files and of none are errors.
    """
    if bad := wanted.filter(F.col("path").rlike(r"(^/|(^|/)\.\.(/|$))")).head(1):
        raise ContractError(f"a path leaves its root: {bad[0]['path']}")

    def name(path: Column) -> Column:
        return F.regexp_extract(path, "([^/]+)$", 1)

    exact = files.select("path", F.col("path").alias("exact"))
    by_name = files.groupBy(name(F.col("path")).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("only"))
    found = wanted.join(exact, "path", "left").withColumn("name", name(F.col("path"))).join(by_name, "name", "left")
    if bad := found.filter("exact is null and (n is null or n > 1)").head(1):
        raise ContractError(f"{bad[0]['path']} names {bad[0]['n'] or 0} files")
    return found.withColumn("file", F.coalesce("exact", "only")).drop("exact", "only", "n", "name")


def differences(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Entries (key, value) that two tables of settings have otherwise; absent and null are apart."""
    left = a.select(key, F.col(value).alias("left"), F.lit(True).alias("in_left"))
    right = b.select(key, F.col(value).alias("right"), F.lit(True).alias("in_right"))
    both = left.join(right, key, "full")
    return both.filter(~(F.col("left").eqNullSafe(F.col("right")) & F.col("in_left").eqNullSafe(F.col("in_right")))).select(key, "left", "right")


def batches(df: DataFrame, position: str, size: int) -> DataFrame:
    """df with the number of its batch of so many consecutive rows."""
    return df.withColumn("batch", F.floor(F.col(position) / size).cast("long"))


def batch_sizes(df: DataFrame, position: str, size: int) -> DataFrame:
    """batch, n_rows and n_padding (what its last one lacks) of batches of so many consecutive rows."""
    each = batches(df, position, size).groupBy("batch").agg(F.count("*").alias("n_rows"))
    return each.withColumn("n_padding", (F.lit(size) - F.col("n_rows")).cast("long"))


def length_buckets(df: DataFrame, length: str, position: str) -> DataFrame:
    """length, n_rows, first and last position of rows of equal length."""
    return df.groupBy(length).agg(F.count("*").alias("n_rows"), F.min(position).alias("first"), F.max(position).alias("last"))

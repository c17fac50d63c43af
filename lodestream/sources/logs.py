"""Prediction logs, scorers' logs and scores as DataFrames, and the writers of what scorers take."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import REDACTED, SECRET_NAMES, stripped
from ..operators.evaluation import benchmark_record, flattened, has_error, merged_record
from ..operators.ordering import with_group_position
from .tables import ContractError


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (bigger further down a file) and value of the lines of text files that aren't blank.

    Numbers come from where a line's part of the file begins, so a large file may be read in parts.
    """
    rows = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    placed = (F.col("block") * F.lit(1 << 20) + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("line")
    return rows.select("file", placed, "value").filter(stripped(F.col("value")) != "")


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of lines() with line as the place (from 0) in the file."""
    return with_group_position(rows.withColumnRenamed("line", "_line"), "file", [F.col("_line")], "line").drop("_line")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """line, id, row_index, prediction, failed and source_record (JSON) of a log; a line that is no JSON object is an error."""
    rows = lines(spark, path)
    if bad := rows.filter(F.json_object_keys("value").isNull()).head(1):
        raise ContractError(f"a log's line is no object: {bad[0]['value'][:80]}")

    def field(name: str) -> Column:
        return F.get_json_object("value", f"$.{name}")

    return rows.select("line", field("id").alias("id"), field("row_index").cast("long").alias("row_index"), field("prediction").alias("prediction"), has_error(F.col("value")).alias("failed"), field("source_record").alias("source_record"))


def last_match(log: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """One row: the groups of the last line of a log (line, value) that has the pattern."""
    groups = F.array(*(F.regexp_extract("value", pattern, k + 1) for k in range(len(names))))
    found = log.filter(F.regexp_like("value", F.lit(pattern))).agg(F.max_by(groups, "line").alias("g"))
    return found.select(*(F.col("g")[k].alias(n) for k, n in enumerate(names)))


def last_result(log: DataFrame) -> DataFrame:
    """One row: the last dictionary on a scorer's information lines, as a map of JSON values."""
    text = F.regexp_extract("value", r" - (\{.*\})\s*$", 1)
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "'", '"'), r"\bNone\b", "null"), r"\b(nan|True|False)\b", "null")
    found = log.filter(F.col("value").contains(" | INFO ") & F.col("value").contains(" - {"))
    return found.agg(F.max_by(body, "line").alias("result")).select(F.from_json("result", "map<string,string>").alias("result"))


def score_tree(spark: SparkSession, root: str) -> DataFrame:
    """subset, metric, value and n of the scores below a folder: <subset>/scoring/scores.json."""
    rows = spark.read.text(f"{root}/*/scoring/scores.json", wholetext=True)
    metrics = F.from_json(F.get_json_object("value", "$.aggregate_metrics"), "map<string,struct<value: double, count: bigint>>")
    subset = F.regexp_extract(F.input_file_name(), "([^/]+)/scoring/scores.json$", 1)
    return rows.select(subset.alias("subset"), F.explode(metrics).alias("metric", "m")).select("subset", "metric", F.col("m.value").alias("value"), F.col("m.count").alias("n"))


# What each scorer's file calls the prediction.
_OUTPUT_NAMES = {"mmau_json": "model_output", "mmau_pro_parquet": "model_output", "voicebench_jsonl": "response", "mmsu_jsonl": "response", "mmar_jsonl": "answer_prediction"}


def scorer_input(records: DataFrame, kind: str, subset: str = "") -> DataFrame:
    """value: the JSON lines that a scorer takes, of records (id, prediction, source_record)."""
    if kind in _OUTPUT_NAMES:
        record = merged_record(F.col("source_record"), **{_OUTPUT_NAMES[kind]: F.col("prediction")})
        return records.select(F.to_json(flattened(record, "other_attributes") if kind == "mmau_json" else record).alias("value"))
    if kind == "keval_jsonl":
        return records.select(F.to_json(F.struct("id", "prediction")).alias("value"))
    if kind == "flexeval_jsonl":
        return records.select(F.to_json(benchmark_record(F.lit(subset), F.col("prediction"), F.col("source_record"))).alias("value"))
    raise ContractError(f"unknown scorer's format: {kind}")


def ground_truth(records: DataFrame) -> DataFrame:
    """value: the source records under the ids that predictions have."""
    return records.select(F.to_json(merged_record(F.col("source_record"), id=F.col("id"))).alias("value"))


def write_lines(rows: DataFrame, path: str) -> None:
    rows.select("value").write.text(path)


def append_redacted(rows: DataFrame, path: str) -> None:
    """Appends rows as JSON with sorted keys; values of names that speak of secrets are blotted out, at any depth of structs."""

    def blotted(kind, value: Column) -> Column:
        if kind.typeName() != "struct":
            return value
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.struct(*((F.lit(REDACTED) if _secret(f.name) else blotted(f.dataType, value[f.name])).alias(f.name) for f in fields))

    fields = sorted(rows.schema.fields, key=lambda f: f.name)
    out = [(F.lit(REDACTED) if _secret(f.name) else blotted(f.dataType, F.col(f.name))).alias(f.name) for f in fields]
    rows.select(F.to_json(F.struct(*out), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def _secret(name: str) -> bool:
    return any(x in name.lower() for x in SECRET_NAMES)


def save_ids(ids: DataFrame, path: str) -> None:
    """Committed ids, sorted, one a line."""
    column = ids.columns[0]
    ids.repartitionByRange(column).sortWithinPartitions(column).select(F.col(column).cast("string")).write.option("compression", "gzip").text(path)


def load_ids(spark: SparkSession, path: str, name: str = "audio_id") -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias(name))


def candidate_files(root: str, subset: str) -> list[str]:
    """Where a benchmark's rows lie: its subset's folder, else Parquet at the root, else below it, else JSON of its name."""

    def parquet(folder: str) -> list[str]:
        return sorted(os.path.join(folder, x) for x in os.listdir(folder) if x.endswith(".parquet")) if os.path.isdir(folder) else []

    if subset != "default" and (found := parquet(os.path.join(root, subset))):
        return found
    if found := parquet(root):
        return found
    if found := sorted(os.path.join(d, x) for d, _, names in os.walk(root) for x in names if x.endswith(".parquet")):
        return found
    found = [p for x in dict.fromkeys((subset, "test", "data", "default")) for end in (".jsonl", ".json") if os.path.isfile(p := os.path.join(root, x + end))]
    if not found:
        raise ContractError(f"no rows of {subset} under {root}")
    return found


def benchmark_rows(spark: SparkSession, files: list[str]) -> DataFrame:
    """Rows of benchmark files of one kind."""
    if files[0].endswith(".parquet"):
        return spark.read.parquet(*files)
    return spark.read.option("multiLine", str(files[0].endswith(".json")).lower()).json(files)


def nested_durations(spark: SparkSession, paths: dict[str, str], field: str = "data") -> DataFrame:
    """split, id and duration_seconds of JSON files that hold an array of objects."""
    parts = []
    for split, path in paths.items():
        rows = spark.read.option("multiLine", "true").json(path).select(F.explode(field).alias("x"))
        parts.append(rows.select(F.lit(split).alias("split"), F.col("x.id").cast("string").alias("id"), F.col("x.duration").cast("double").alias("duration_seconds")))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    if bad := out.filter("duration_seconds is null").head(1):
        raise ContractError(f"no duration of {bad[0]['id']}")
    return out

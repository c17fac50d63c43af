"""Benchmark rows, prediction logs and the inputs of scorers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ID_NAMES, QUESTION_NAMES, audio_paths, choices, first_text
from ..sources.tables import ContractError


def normalised(df: DataFrame) -> DataFrame:
    """sample_id, question, choices, audio and source_record (JSON without binary columns) of benchmark rows of any shape."""
    plain = [c for c, t in df.dtypes if "binary" not in t]
    record = F.to_json(F.struct(*sorted(plain)), {"ignoreNullFields": "false"})
    named = first_text(df, ID_NAMES)
    sample_id = F.when(named != "", named).otherwise(F.sha2(record, 256))
    return df.select(sample_id.alias("sample_id"), first_text(df, QUESTION_NAMES).alias("question"), choices(df).alias("choices"), audio_paths(df).alias("audio"), record.alias("source_record"))


def has_error(line: Column) -> Column:
    """Whether a JSON object has the key error, be its value null."""
    return F.coalesce(F.array_contains(F.json_object_keys(line), "error"), F.lit(False))


def prediction_key(row_index: Column, sample_id: Column, by_id: bool = False) -> Column:
    """What a prediction is of, with the kind of key, so that row 1 is not id 1."""
    named = F.concat(F.lit("id:"), F.coalesce(sample_id.cast("string"), F.lit("")))
    return named if by_id else F.coalesce(F.concat(F.lit("row:"), row_index.cast("string")), named)


def last_wins(df: DataFrame, key: Column, line: str, payload: list[str]) -> DataFrame:
    """The last row of each key, with first_line, the line of its first: partial aggregates keep one row a key and task."""
    newest = F.max_by(F.struct(*payload), line)
    return df.groupBy(key.alias("_key")).agg(F.min(line).alias("first_line"), newest.alias("_row")).select("first_line", "_row.*")


def completed_rows(log: DataFrame, n_rows: int) -> DataFrame:
    """row_index of the rows that a log (line, row_index, failed) holds done; rows without an index count by their line.

    A log that has failed rows without an index can't be resumed, nor one with an index beyond the source.
    """
    found = log.agg(
        F.count_if(F.col("row_index").isNull() & F.col("failed")).alias("unplaced"),
        F.count_if((F.coalesce("row_index", "line") < 0) | (F.coalesce("row_index", "line") >= n_rows)).alias("outside"),
    ).first()
    if found["unplaced"]:
        raise ContractError("failed rows without an index can't be placed")
    if found["outside"]:
        raise ContractError("a row's index lies outside the source")
    return log.filter("not failed").select(F.coalesce("row_index", "line").alias("row_index")).distinct()


def pending(source: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of source that aren't done; what is done but not in source is an error."""
    if odd := done.join(source.select(key), key, "left_anti").head(1):
        raise ContractError(f"{key} {odd[0][key]} is done but not in the source")
    return source.join(done.select(key), key, "left_anti")


def merged_record(record: Column, **values: Column) -> Column:
    """A JSON object, as a map of JSON values, with further text values put in (or over)."""
    parsed = F.from_json(record, "map<string,string>")
    names = F.array(*map(F.lit, values))
    kept = F.map_filter(parsed, lambda k, _: ~F.array_contains(names, k))
    return F.map_concat(kept, F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]))


def flattened(record: Column, attribute: str) -> Column:
    """A map whose attribute holds a JSON object: that object's entries at the top, over what is there."""
    inner = F.coalesce(F.from_json(F.try_element_at(record, F.lit(attribute)), "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(record, lambda k, _: (k != attribute) & ~F.map_contains_key(inner, k)), inner)


def benchmark_record(subset: Column, prediction: Column, record: Column) -> Column:
    """What the scorer of each Japanese subset takes: lm_output, references and task_inputs (JSON); an unknown subset is an error."""

    def field(name: str) -> Column:
        return F.get_json_object(record, f"$.{name}")

    chat = F.array(F.struct(F.lit("user").alias("role"), field("text").alias("content")))
    none = F.array().cast("array<string>")
    spoken = subset.isin("elyza", "spoken-elyza")
    known = subset.isin("elyza", "spoken-elyza", "m-ifeval", "jamc-qa")
    inputs = (
        F.when(spoken, F.to_json(F.struct(chat.alias("messages"), field("eval_aspect").alias("eval_aspect"))))
        .when(subset == "m-ifeval", F.concat(F.lit('{"constraints":'), field("constraints"), F.lit("}")))
        .when(subset == "jamc-qa", F.to_json(F.struct(field("category").alias("category"))))
        .otherwise(F.raise_error(F.concat(F.lit("unknown subset "), subset)).cast("string"))
    )
    references = F.when(spoken, F.array(field("reference"))).when(subset == "jamc-qa", F.array(field("answer_choice"))).otherwise(none)
    return F.struct(prediction.alias("lm_output"), F.when(known, references).alias("references"), inputs.alias("task_inputs"))


def index_in_name(sample_id: Column) -> Column:
    """The number behind an id's last hyphen; null if it is none."""
    return F.regexp_extract(sample_id, "-([^-]*)$", 1).try_cast("int")


def judge_key(df: DataFrame) -> Column:
    """Identity of a judge's row: id, key, or prompt and reference; null where it has none."""
    names = [F.nullif(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("0")) for c in ("id", "key") if c in df.columns]
    pair = F.when(F.col("prompt").isNotNull() | F.col("reference").isNotNull(), F.to_json(F.array("prompt", "reference"), {"ignoreNullFields": "false"}))
    return F.coalesce(*names, pair)


def aligned_judgements(results: DataFrame, wanted: DataFrame, index: str) -> DataFrame | None:
    """results joined to wanted by index, or None if they aren't exactly those wanted, once each."""
    a = wanted.select(index, F.lit(1).alias("_w")).join(results.groupBy(index).agg(F.count("*").alias("_r")), index, "full")
    if a.filter("coalesce(_w, 0) != 1 or coalesce(_r, 0) != 1").head(1):
        return None
    return wanted.join(results, index)


def context_faults(items: DataFrame, request: str, most_items: int, most_seconds: float, reserve: int, output: int, model_length: int) -> DataFrame:
    """Requests whose items (seconds, tokens, words of each) break a limit, and which; one such fails the selection."""
    each = items.groupBy(request).agg(F.count("*").alias("n_items"), F.max("seconds").alias("longest"), F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))
    slack = 1e-6 / 16_000
    rule = (
        F.when(F.col("n_items") > most_items, "items")
        .when(F.col("longest") > most_seconds + slack, "seconds")
        .when(F.col("tokens") + F.col("words") + reserve + output > model_length, "context")
    )
    return each.select(request, rule.alias("rule"), "n_items", "tokens").filter("rule is not null")

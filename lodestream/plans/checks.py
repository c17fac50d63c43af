"""Queries of contracts: what rows break them, and which of them stop a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio
from ..functions.text import words
from ..operators import catalog, evaluation, generation, ordering, packing, settings, validation
from ..sources.tables import ContractError, catalog_path, table
from .bridges import lengths
from .registry import query


def _outcome(run: Callable[[], object]) -> str:
    """ok, or the kind of error that a check raises."""
    try:
        run()
    except ContractError as error:
        return type(error).__name__
    return "ok"


@query(
    "checks_that_stop",
    """
SELECT unnest(['apart', 'apart_of_others', 'bad_samples', 'bad_samples_beyond', 'covered', 'missing_path', 'none', 'oversized', 'paired', 'repeated', 'same_lengths', 'unique', 'source', 'unknown_provider', 'without_splits', 'missing_overlay', 'forbidden_split', 'guarded_split', 'guarded_split_allowed']) AS name, unnest([
  CASE WHEN (SELECT count(*) FILTER (quality = 1 AND toxic = 1) FROM labels) > 0 THEN 'LeakageError' ELSE 'ok' END, 'ok', 'ok',
  CASE WHEN (SELECT count(*) FILTER (value IS NULL OR value <= 0) FROM events) > 0 THEN 'LimitExceeded' ELSE 'ok' END,
  CASE WHEN (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) > 0 THEN 'MissingRows' ELSE 'ok' END,
  'ContractError', CASE WHEN (SELECT count(*) FROM documents WHERE lang IS NULL) > 0 THEN 'ContractError' ELSE 'ok' END,
  'OversizedExample',
  CASE WHEN (SELECT count(*) FROM (SELECT conv_id FROM conversations WHERE role = 'user' GROUP BY 1 HAVING count(*) > 1)) > 0 THEN 'MissingRows' ELSE 'ok' END,
  CASE WHEN (SELECT count(*) - count(DISTINCT user_id) FROM events) > 0 THEN 'DuplicateKey' ELSE 'ok' END,
  CASE WHEN (SELECT count(*) FILTER (n_chars IS DISTINCT FROM length(text)) FROM documents) > 0 THEN 'ContractError' ELSE 'ok' END, 'ok', 'ok', 'ContractError', 'ContractError', 'ContractError', 'ContractError', 'ContractError', 'ok']) AS outcome
""",
)
def checks_that_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks over whole tables, and whether each passes or what it raises."""
    docs, labels, events, turns = (table(spark, sf_dir, x) for x in ("documents", "labels", "events", "conversations"))
    marks = [F.when(F.col("quality") == 1, F.lit("good")), F.when(F.col("toxic") == 1, F.lit("toxic"))]
    splits = labels.select("doc_id", F.filter(F.array(*marks), lambda x: x.isNotNull()).alias("splits"))
    bad = F.col("value").isNull() | (F.col("value") <= 0)
    runs = {
        "unique": lambda: validation.require_unique(docs, "doc_id"),
        "repeated": lambda: validation.require_unique(events, "user_id"),
        "covered": lambda: validation.require_covered(docs, labels, "doc_id"),
        "apart": lambda: validation.require_apart(splits, "splits", [("good", "toxic")]),
        "apart_of_others": lambda: validation.require_apart(splits, "splits", [("good", "dev")]),
        "bad_samples": lambda: validation.require_at_most(events, bad, 1 << 30),
        "bad_samples_beyond": lambda: validation.require_at_most(events, bad, 0),
        "none": lambda: validation.require_none(validation.faults(docs, {"lang": F.col("lang").isNotNull()})),
        "same_lengths": lambda: validation.require_none(validation.faults(docs, {"length": F.col("n_chars") == F.length("text")})),
        "oversized": lambda: packing.packed(packing.windows(lengths(spark, sf_dir), "worker", [F.col("doc_id")], 64), "worker", "length", 1, oversized="error"),
        "paired": lambda: catalog.paired_sources(turns, "conv_id", "role", "assistant", "user"),
        "source": lambda: settings.require_source(spark, "own", ["own", "overlay"], ["dev"], f"{sf_dir}/documents.parquet"),
        "unknown_provider": lambda: settings.require_source(spark, "other", ["own"], ["dev"]),
        "without_splits": lambda: settings.require_source(spark, "own", ["own"], []),
        "missing_overlay": lambda: settings.require_source(spark, "own", ["own"], ["dev"], f"{sf_dir}/nothing.parquet"),
        "forbidden_split": lambda: settings.require_split("test", ["test"], ["holdout"]),
        "guarded_split": lambda: settings.require_split("holdout", ["test"], ["holdout"]),
        "guarded_split_allowed": lambda: settings.require_split("holdout", ["test"], ["holdout"], True),
        "missing_path": lambda: catalog_path(spark, sf_dir, "nowhere", "nothing"),
    }
    return spark.createDataFrame([(name, _outcome(run)) for name, run in runs.items()], "name string, outcome string")


@query(
    "bad_sample_budget",
    "SELECT event_type, count(*) AS seen, count(*) FILTER (value IS NULL OR value <= 0) AS skipped, round(count(*) FILTER (value IS NULL OR value <= 0) / greatest(1, count(*)), 9) AS exclusion_rate FROM events GROUP BY event_type",
)
def bad_sample_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that are skipped as planned for nothing, and their share."""
    events = table(spark, sf_dir, "events")
    bad = ~F.coalesce(F.col("value") > 0, F.lit(False))
    return events.groupBy("event_type").agg(F.count("*").alias("seen"), F.count_if(bad).alias("skipped"), F.round(catalog.exclusion_rate(F.count_if(bad), F.count_if(~bad)), 9).alias("exclusion_rate"))


@query("first_split_rows", "SELECT doc_id, lang AS split FROM documents WHERE lang IN ('en', 'de')")
def first_split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose first split is listed; without splits a row isn't."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("lang").isNotNull(), F.array("lang", F.lit("en"))).alias("splits"))
    return rows.filter(catalog.first_split("splits", ["en", "de"])).select("doc_id", F.col("splits")[0].alias("split"))


@query(
    "aligned_judgements",
    """
SELECT 'whole' AS kind, count(*) AS n_rows FROM benchmark UNION ALL SELECT 'one lacking', -1 UNION ALL SELECT 'one twice', -1
""",
)
def aligned_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a judge are taken again only if they are those wanted, once each."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("index"), "text")
    results = items.select("index", F.length("text").alias("score"))
    first = results.agg(F.min("index").alias("index"))
    cases = {"whole": results, "one lacking": results.join(first, "index", "left_anti"), "one twice": results.union(results.join(first, "index", "left_semi"))}
    found = {k: evaluation.aligned_judgements(v, items, "index") for k, v in cases.items()}
    return spark.createDataFrame([(k, -1 if v is None else v.count()) for k, v in found.items()], "kind string, n_rows long")


@query(
    "setting_differences",
    """
WITH a AS (SELECT n_name AS k, CAST(n_regionkey AS VARCHAR) AS v FROM nation WHERE n_nationkey <> 3), b AS (SELECT n_name AS k, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(n_regionkey AS VARCHAR) END AS v FROM nation WHERE n_nationkey <> 5)
SELECT coalesce(a.k, b.k) AS name, a.v AS "left", b.v AS "right" FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v OR a.k IS NULL OR b.k IS NULL
""",
)
def setting_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that two tables of settings have otherwise, absent and null being apart."""
    nation, value = table(spark, sf_dir, "nation"), F.col("n_regionkey").cast("string")
    a = nation.filter("n_nationkey <> 3").select(F.col("n_name").alias("name"), value.alias("value"))
    b = nation.filter("n_nationkey <> 5").select(F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 4 != 0, value).alias("value"))
    return generation.differences(a, b, "name", "value")


_SOUND = {
    "data": {"dataset": "corpus", "train_split": "a", "validation_split": "b", "final_split": "c", "num_workers": 2, "max_audio_seconds": 30.0},
    "prompt": {"prompt_file": "p.txt"},
    "frontend": {"kind": "whisper", "max_seconds": 30.0},
    "packing": {"max_lfm_tokens": 16384, "max_sample_lfm_tokens": 8192},
}
_RUNTIME = {"server": {"max_model_len": 4096, "audio_limit": 3, "max_audio_decode_duration_seconds": 600.0}, "client": {"max_model_len": 4096, "max_audio_seconds": 600}}
_EXPORT = {"model_type": "m", "architectures": ["A"], "text_tokenizer_size": 100, "audio_token_index": 100, "text_model_revision": "0" * 40, "audio_model_revision": "a" * 40}


def _changed(base: dict, path: str, value: object) -> dict:
    head, _, rest = path.partition(".")
    return {**base, head: _changed(base.get(head) or {}, rest, value) if rest else value}


#: Changes to sound settings and the rule that each breaks.
_CHANGES = [
    ("training", "data.long_audio_policy", "chunk_pad", "chunks_together"),
    ("training", "data.num_workers", 0, "workers_persist"),
    ("training", "packing.max_sample_lfm_tokens", 20000, "sample_limit"),
    ("training", "prompt.prompt_file", None, "plain_prompt"),
    ("training", "prompt.mode", settings.EXPANDED_MODE, "expansion_together"),
    ("training", "data.target_provider", settings.EXPANDED_PROVIDER, "expansion_together"),
    ("training", "data.training_sources", [{"dataset": "x", "splits": ["a"]}] * 2, "sources_unique"),
    ("training", "data.training_sources", [{"dataset": "x", "splits": ["a", "a"]}], "source_splits"),
    ("training", "optimization", {"torch_compile": True, "compile_whisper_encoder": True}, "compiled_shapes"),
    ("training", "data.max_audio_seconds", 20.0, ""),
    ("runtime", "client.max_model_len", 2048, "model_length"),
    ("runtime", "server.audio_limit", 2, "audio_limit"),
    ("runtime", "client.max_audio_seconds", 30, "audio_seconds"),
    ("export", "audio_token_index", 99, "audio_token"),
    ("export", "text_tokenizer_size", 0, "tokenizer_size"),
    ("export", "text_model_revision", "main", "revisions"),
    ("export", "model_type", "other", "model_type"),
    ("splits", "data.final_split", "test", "forbidden_split"),
    ("splits", "data.train_split", "b", "fixed_splits"),
    ("splits", "data.dataset", "another", ""),
]


@query("setting_rules", "SELECT * FROM (VALUES " + ", ".join(f"('{kind}', {k}::BIGINT, '{rule}')" for k, (kind, _, _, rule) in enumerate(_CHANGES)) + ") AS t(kind, change, first_rule)")
def setting_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each change to sound settings breaks."""
    kinds = {"training": (_SOUND, settings.TRAINING), "runtime": (_RUNTIME, settings.RUNTIME), "export": (_EXPORT, settings.export_rules("m", "A")), "splits": (_SOUND, settings.split_rules("corpus", ("a", "b", "c"), ("test",)))}
    for base, rules in kinds.values():
        settings.require_settings(base, rules)
    found = [(kind, k, next(iter(settings.broken(_changed(kinds[kind][0], path, value), kinds[kind][1])), "")) for k, (kind, path, value, _) in enumerate(_CHANGES)]
    return spark.createDataFrame(found, "kind string, change long, first_rule string")


@query(
    "unknown_values",
    """
WITH s AS (SELECT source, list_sort(list_filter(list(DISTINCT coalesce(lang, 'none')), lambda x: x NOT IN ('en', 'fr'))) AS odd FROM documents GROUP BY source)
SELECT source, array_to_string(odd, ',') AS unknown, len(odd) = 0 AS subset FROM s
""",
)
def unknown_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each source that an enumeration lacks."""
    each = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set(F.coalesce("lang", F.lit("none"))).alias("langs"))  # as many as languages
    odd = F.array_sort(settings.outside(F.col("langs"), ["en", "fr"]))
    return each.select("source", F.array_join(odd, ",").alias("unknown"), (F.size(odd) == 0).alias("subset"))


@query("export_names", "SELECT c_custkey, 'target.w' || c_custkey AS mapped FROM customer")
def export_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of weights in an export."""
    weights = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("own."), F.lit("w"), F.col("c_custkey").cast("string")).alias("name"))
    return settings.mapped_names(weights, "name", "own.", "target.").select("c_custkey", "mapped")


@query(
    "waveform_faults",
    """
SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN 'sample_rate' WHEN vec_id % 5 = 0 THEN 'empty' WHEN vec_id % 3 = 0 THEN 'not_finite' END AS fault FROM embeddings
""",
)
def waveform_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with vectors as waveforms, some of them of another rate, emptied or with an infinite sample."""
    n, v = F.col("vec_id"), F.col("embedding").cast("array<double>")
    made = F.when(n % 5 == 0, F.array().cast("array<double>")).when(n % 3 == 0, F.concat(v, F.array(F.lit(float("inf"))))).otherwise(v)
    rate = F.when(n % 7 == 0, 44100).otherwise(16000)
    return table(spark, sf_dir, "embeddings").select("vec_id", audio.raw_audio_fault(made, rate, 1).alias("fault"))


@query(
    "feature_faults",
    """
WITH c AS (SELECT conv_id, list(CAST(length(text) % 9 AS BIGINT)) AS n, CAST(sum(length(text) % 9) AS BIGINT) + CASE WHEN conv_id % 4 = 0 THEN 1 ELSE 0 END AS total FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN len(list_filter(n, lambda x: x <= 0)) > 0 THEN 'empty_chunk' WHEN list_sum(n) <> total THEN 'length_mismatch' END AS fault FROM c
""",
)
def feature_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with features in chunks: a conversation's turns are its chunks."""
    n = (F.length("text") % 9).cast("long")
    each = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(n).alias("chunks"), F.sum(n).alias("total"))
    total = F.col("total") + F.when(F.col("conv_id") % 4 == 0, 1).otherwise(0)
    return each.select("conv_id", audio.feature_fault(F.col("chunks"), total).alias("fault"))


@query(
    "layout_faults",
    """
WITH t AS (SELECT conv_id, turn, 3 + length(text) % 5 AS n FROM conversations),
g AS (SELECT conv_id, sum(n) AS n, conv_id % 5 = 1 AS outside, conv_id % 5 = 2 AS unsupervised FROM t GROUP BY conv_id)
SELECT conv_id, CASE WHEN n > 40 THEN 'too_long' WHEN outside THEN 'vocabulary' ELSE 'nothing_supervised' END AS rule FROM g WHERE n > 40 OR outside OR unsupervised
""",
)
def layout_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs of turns that are too long, hold an id outside the vocabulary or have nothing that the loss takes."""
    key, none = F.col("conv_id") % 5, F.array().cast("array<int>")
    n = (F.length("text") % 5).cast("int")
    body = F.concat(F.array(F.when(key == 1, F.lit(9999)).otherwise(1)), F.when(n > 0, F.array_repeat(F.lit(5), n)).otherwise(none))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(key == 2, body).otherwise(none).alias("before"), F.lit(0).alias("audio"), none.alias("after"), F.when(key == 2, none).otherwise(body).alias("target"))
    tokens = packing.layout(rows, ["conv_id"], [F.col("turn")])
    return packing.layout_faults(tokens, ["conv_id"], 40, 1000)


@query(
    "limited_targets",
    "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations) WHERE n <= 100",
)
def limited_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first targets of a total order: the feature is the limit."""
    return ordering.first_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn"), [F.col("conv_id"), F.col("turn")], 100)


@query("sorted_places", "SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) - 1 AS position FROM documents")
def sorted_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in order of shard and key."""
    return ordering.with_position(table(spark, sf_dir, "documents").select("source", "doc_id"), [F.col("source"), F.col("doc_id")])


@query(
    "united_datasets",
    "SELECT 'documents' AS dataset, CAST(doc_id AS VARCHAR) AS audio_id, CAST(n_chars AS BIGINT) AS length FROM documents UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR), CAST(length(html) AS BIGINT) FROM pages",
)
def united_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two datasets as one bag of rows."""
    parts = {
        "documents": table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("audio_id"), F.col("n_chars").cast("long").alias("length")),
        "pages": table(spark, sf_dir, "pages").select(F.length("html").cast("long").alias("length"), F.col("page_id").cast("string").alias("audio_id")),
    }
    return catalog.united(parts, "dataset")


@query("realised_lengths", "SELECT 'audio' AS rule, count(*) FILTER (doc_id % 8 = 0 AND n_chars > 0) AS n_rows FROM documents UNION ALL SELECT 'words', 0 FROM (SELECT 1)")
def realised_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths as planned and as they came out."""
    docs = table(spark, sf_dir, "documents")
    planned = F.col("n_chars").cast("long") * 160
    realised = F.when(F.col("doc_id") % 8 == 0, planned - F.least(planned, F.lit(1))).otherwise(planned)
    return validation.faults(docs, {"audio": planned == realised, "words": words(F.col("text")) >= 0})

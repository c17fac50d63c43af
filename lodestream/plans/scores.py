"""Queries of prediction logs, scorers' inputs and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.hashing import is_revision, sha256
from ..operators import evaluation, metrics
from ..sources.tables import table
from .registry import query, strip_sql


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a prediction log."""
    record = F.to_json(F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("prediction")))
    failed = F.to_json(F.struct(F.col("user_id").alias("id"), F.lit(None).cast("string").alias("error")), {"ignoreNullFields": "false"})
    line = F.when(F.col("event_type") == "error", failed).otherwise(record)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", line.alias("line"))


@query(
    "prediction_last_wins",
    """
SELECT 'id:' || user_id AS sample, min(event_id) AS first_line, max(event_id) AS event_id, arg_max(event_type, event_id) AS prediction
FROM events WHERE event_type <> 'error' GROUP BY user_id
""",
)
def prediction_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir).filter(~evaluation.has_error(F.col("line")))
    key = evaluation.prediction_key(F.lit(None), F.col("user_id"))
    kept = evaluation.last_wins(log.withColumn("sample", key), key, "event_id", ["sample", "event_id", "event_type"])
    return kept.select("sample", "first_line", "event_id", F.col("event_type").alias("prediction"))


@query(
    "resume_row_indices",
    """
SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN user_id ELSE event_id END AS row_index FROM events WHERE event_type <> 'error'
""",
)
def resume_row_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    index = F.when(F.col("user_id") % 2 == 0, F.col("user_id")).when(F.col("event_type") == "error", F.col("user_id"))
    log = events.select(F.col("event_id").alias("line"), index.alias("row_index"), (F.col("event_type") == "error").alias("failed"))
    return evaluation.completed_rows(log, 1 << 40)


@query(
    "pending_rows",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'assistant' AND conv_id IN (SELECT doc_id FROM documents))",
)
def pending_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    done = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.col("conv_id").alias("doc_id")).distinct()
    return evaluation.pending(docs, done.join(docs, "doc_id", "left_semi"), "doc_id")


@query("generation_progress", "SELECT count(*) FILTER (event_type <> 'error') AS succeeded, count(*) FILTER (event_type = 'error') AS failed, count(DISTINCT user_id) AS samples FROM events")
def generation_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = evaluation.has_error(F.col("line"))
    return _log(spark, sf_dir).agg(F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), F.countDistinct("user_id").alias("samples"))


@query(
    "majority_vote",
    """
WITH v AS (SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'signup')) AS yes, count(*) FILTER (event_type IN ('view', 'error')) AS no FROM events GROUP BY user_id)
SELECT round(avg(CASE WHEN yes > no THEN 100.0::DOUBLE ELSE 0 END), 9) AS score, count(*) AS n FROM v
""",
)
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes and no votes of each user, written in several ways; a user's are few."""
    vote = F.when(F.col("event_type").isin("purchase", "signup"), " Yes\t").when(F.col("event_type").isin("view", "error"), "\nNO").otherwise("unsure")
    each = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_list(vote).alias("votes"))
    return each.agg(F.round(F.avg(F.when(text.yes_wins(F.col("votes")), 100.0).otherwise(0.0)), 9).alias("score"), F.count("*").alias("n"))


@query(
    "null_as_zero_mean",
    """
SELECT lang, round(avg(coalesce(quality, 0)), 9) AS mean_quality, count(*) AS n_rows, count(*) FILTER (quality IS NULL) AS unparsed
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
""",
)
def null_as_zero_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("lang").agg(F.round(numbers.full_mean(F.col("quality")), 9).alias("mean_quality"), F.count("*").alias("n_rows"), F.count_if(F.col("quality").isNull()).alias("unparsed"))


@query(
    "category_macro_mean",
    """
SELECT round(avg(m), 9) AS score, count(*) AS n_categories FROM (
  SELECT avg(coalesce(quality, 0)) AS m FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
""",
)
def category_macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    found = metrics.macro_mean(joined, "source", F.col("quality").cast("double"))
    return found.select(F.round("score", 9).alias("score"), "n_categories")


@query(
    "multi_category_means",
    """
SELECT category, round(avg(coalesce(toxic, 0)), 9) AS mean_toxic, count(*) AS n_rows FROM (
  SELECT unnest([lang, source]) AS category, toxic FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY category
""",
)
def multi_category_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    each = joined.select(F.explode(F.array("lang", "source")).alias("category"), "toxic")
    return each.groupBy("category").agg(F.round(numbers.full_mean(F.col("toxic")), 9).alias("mean_toxic"), F.count("*").alias("n_rows"))


@query("weighted_accuracy", "SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS accuracy, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag")
def weighted_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    accuracy = numbers.weighted_mean(F.col("l_discount"), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(accuracy, 9).alias("accuracy"), F.sum("l_quantity").cast("long").alias("n"))


_POINTS = {"click": 0.5, "purchase": 1.0, "signup": 0.75, "share": 0.25}


@query(
    "label_distribution",
    "WITH k(label, points) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _POINTS.items()) + """),
t AS (SELECT count(*) AS total FROM events), c AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1)
SELECT label, coalesce(n, 0) AS n_rows, round(coalesce(n, 0) / total, 9) AS share, round(coalesce(n, 0) * points / total, 9) AS score FROM k LEFT JOIN c USING (label), t
""",
)
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.label_distribution(table(spark, sf_dir, "events"), "event_type", _POINTS)
    return found.select("label", "n_rows", F.round("share", 9).alias("share"), F.round("score", 9).alias("score"))


_PROFILE = [("EUROPE", 0.0, -1000.0, 1000.0), ("ASIA", 5000.0, 4000.0, 9000.0), ("AFRICA", 0.0, -9000.0, 9000.0), ("ATLANTIS", 1.0, 0.0, 2.0)]


@query(
    "reference_range_check",
    "WITH p(metric, minimum, maximum) AS (VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, _, a, b in _PROFILE) + """),
s AS (SELECT r_name AS metric, avg(s_acctbal) AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT metric, round(value, 4) AS value, CASE WHEN value IS NULL THEN 'missing' WHEN value BETWEEN minimum AND maximum THEN 'pass' ELSE 'fail' END AS status FROM p LEFT JOIN s USING (metric)
""",
)
def reference_range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    scores = joined.groupBy(F.col("r_name").alias("metric")).agg(F.avg("s_acctbal").alias("value"))
    profile = spark.createDataFrame(_PROFILE, "metric string, expected double, minimum double, maximum double")
    return metrics.range_check(scores, profile).select("metric", F.round("value", 4).alias("value"), "status")


@query(
    "choice_match_cosine",
    """
WITH e AS (SELECT label, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
c AS (SELECT label AS choice, arg_min(v, vec_id) AS c FROM e GROUP BY label),
s AS (SELECT vec_id, choice, list_sum(list_transform(list_zip(v, c), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(v, lambda x: x * x))) / sqrt(list_sum(list_transform(c, lambda x: x * x))) AS score FROM e, c)
SELECT vec_id, arg_max(choice, score) AS choice FROM s GROUP BY vec_id
""",
)
def choice_match_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The choice that each vector is nearest to; a label's first vector is its choice, so there are as many as labels."""
    rows = table(spark, sf_dir, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("choice"))
    options = first.agg(F.array_sort(F.collect_list(F.struct("label", "choice"))).alias("options"))  # one row
    scores = F.transform("options", lambda o: F.struct(numbers.cosine(F.col("embedding"), o["choice"]).alias("score"), o["label"].alias("label")))
    best = rows.join(F.broadcast(options), F.lit(True)).select("vec_id", F.array_max(scores).alias("b"))
    return best.select("vec_id", F.col("b.label").alias("choice"))


@query(
    "vector_norms",
    """
SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) / len(embedding)), 6) AS rms, len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AS finite, CAST((len(embedding) + 4) // 5 AS INTEGER) AS stacks
FROM embeddings
""",
)
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.audio import all_finite, stacked

    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(numbers.rms(v), 6).alias("rms"), all_finite(v).alias("finite"), F.size(stacked(v, 5)).alias("stacks"))


_OPTION_SQL = """CASE WHEN p IS NULL OR p = 'None' THEN NULL WHEN regexp_matches(substr(p, 1, 1), '^[A-D]$') THEN substr(p, 1, 1)
  WHEN length(p) > 1 AND regexp_matches(substr(p, length(p) - 1, 1), '^[A-D]$') THEN substr(p, length(p) - 1, 1) END"""


@query(
    "option_letter_parse",
    f"""
WITH r AS (SELECT conv_id, turn, replace({strip_sql('text')}, chr(10), '') AS p FROM conversations), o AS (SELECT conv_id, turn, {_OPTION_SQL} AS letter FROM r)
SELECT letter, count(*) AS n_rows, round(avg(CASE WHEN letter = 'D' THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM o GROUP BY letter
""",
)
def option_letter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = table(spark, sf_dir, "conversations").select(text.option_letter(F.col("text")).alias("letter"))
    right = F.when(F.col("letter") == "D", F.lit(1.0))
    return answers.groupBy("letter").agg(F.count("*").alias("n_rows"), F.round(numbers.full_mean(right), 9).alias("accuracy"))


@query(
    "rating_parse",
    """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN coalesce(CASE WHEN event_id % 9 BETWEEN 1 AND 5 THEN (event_id % 9)::DOUBLE END, 0)
  WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 7 BETWEEN 1 AND 5 THEN (event_id % 7)::DOUBLE ELSE 0 END ELSE 0 END AS rating FROM events
""",
)
def rating_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    said = F.when(n % 3 == 0, (n % 9).cast("string")).when(n % 3 == 1, F.concat(F.lit("I give [["), (n % 7).cast("string"), F.lit("]]."))).otherwise("no rating")
    return table(spark, sf_dir, "events").select("event_id", text.rating(said).alias("rating"))


@query(
    "rubric_scores",
    """
WITH r AS (SELECT event_id, (event_id % 5 + 1)::DOUBLE AS c, (event_id % 4 + 1)::DOUBLE AS r, CASE WHEN event_id % 2 = 0 THEN (event_id % 3 + 1)::DOUBLE ELSE 0 END AS k FROM events)
SELECT event_id, c AS correctness, r AS relevance, k AS completeness, 0.0::DOUBLE AS clarity, CASE WHEN event_id % 6 = 0 THEN 2.5 ELSE (c + r + k + 0) / 4 END AS overall FROM r
""",
)
def rubric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    said = F.concat(
        F.lit("Correctness: "), (n % 5 + 1).cast("string"), F.lit(" - fine\nRELEVANCE: "), (n % 4 + 1).cast("string"),
        F.when(n % 2 == 0, F.concat(F.lit("\ncompleteness : "), (n % 3 + 1).cast("string"))).otherwise(""),
        F.when(n % 6 == 0, F.lit("\nOVERALL: 2.5 - good")).otherwise(""),
    )
    return table(spark, sf_dir, "events").select("event_id", text.rubric(said).alias("s")).select("event_id", "s.*")


@query(
    "json_props_flatten",
    """
SELECT event_id, CAST(len(json_keys(props)) + 1 AS INTEGER) AS n_entries, event_type AS model_output, json_extract_string(props, '$.k') AS k FROM events
""",
)
def json_props_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    record = F.to_json(F.struct(F.col("props").alias("other"), F.lit("old").alias("model_output")))
    flat = evaluation.flattened(evaluation.merged_record(record, model_output=F.col("event_type")), "other")
    return events.select("event_id", flat.alias("m")).select("event_id", F.size("m").alias("n_entries"), F.try_element_at("m", F.lit("model_output")).alias("model_output"), F.try_element_at("m", F.lit("k")).alias("k"))


@query(
    "render_choice_prompt",
    f"""
SELECT item_id, sha256({strip_sql('text')} || chr(10) || chr(10) || 'Choices:' || chr(10) || 'A. yes' || chr(10) || 'B. ' || CAST(item_id AS VARCHAR) || chr(10) || chr(10)
  || 'Respond with the choice letter followed by the choice text.') AS prompt_sha256 FROM benchmark
""",
)
def render_choice_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    options = F.array(F.lit("yes"), F.col("item_id").cast("string"))
    return items.select("item_id", sha256(text.with_choices(F.col("text"), options)).alias("prompt_sha256"))


@query(
    "normalise_rows",
    f"""
SELECT CAST(item_id AS VARCHAR) AS sample_id, {strip_sql('text')} AS question, CAST(2 AS INTEGER) AS n_choices, 'clips/' || item_id || '.wav' AS first_audio FROM benchmark
""",
)
def normalise_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    path = F.concat(F.lit("clips/"), F.col("item_id").cast("string"), F.lit(".wav"))
    raw = items.select(F.lit("\t\xa0").alias("id"), F.col("item_id").alias("key"), F.col("text").alias("instruction"), F.array(F.lit("a"), F.lit(" \n"), F.lit("b")).alias("options"), F.array(path).alias("audio_path"), F.col("text").cast("binary").alias("raw"))
    rows = evaluation.normalised(raw)
    return rows.select("sample_id", "question", F.size("choices").alias("n_choices"), F.col("audio")[0].alias("first_audio"))


@query(
    "context_preflight",
    """
WITH i AS (SELECT conv_id, length(text) * 0.5 AS seconds, length(text) AS tokens, len(regexp_extract_all(text, '\\S+')) AS words FROM conversations),
g AS (SELECT conv_id, count(*) AS n_items, max(seconds) AS longest, CAST(sum(tokens) AS BIGINT) AS tokens, sum(words) AS words FROM i GROUP BY conv_id)
SELECT conv_id, CASE WHEN n_items > 3 THEN 'items' WHEN longest > 60 THEN 'seconds' WHEN tokens + words + 64 + 128 > 600 THEN 'context' END AS rule, n_items, tokens FROM g
WHERE n_items > 3 OR longest > 60 OR tokens + words + 64 + 128 > 600
""",
)
def context_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "conversations").select("conv_id", (F.length("text") * 0.5).alias("seconds"), F.length("text").alias("tokens"), text.words(F.col("text")).alias("words"))
    return evaluation.context_faults(items, "conv_id", 3, 60.0, 64, 128, 600)


@query(
    "two_level_nll",
    """
WITH t AS (SELECT conv_id, length(text)::DOUBLE / 10 AS l, len(regexp_extract_all(text, '\\S+'))::BIGINT AS n FROM conversations WHERE len(regexp_extract_all(text, '\\S+')) > 0),
k AS (SELECT conv_id, sum(l) AS l, sum(n) AS n, sum(l / n) AS o, count(*) AS c FROM t GROUP BY conv_id)
SELECT round(sum(l) / sum(n), 9) AS token_nll, round(sum(o) / sum(c), 9) AS target_nll, round(avg(o / c), 9) AS key_nll, CAST(sum(c) AS BIGINT) AS n_targets, count(*) AS n_keys FROM k
""",
)
def two_level_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.length("text").cast("double") / 10).alias("loss"), text.words(F.col("text")).alias("tokens")).filter("tokens > 0")
    found = metrics.token_nll(rows, "conv_id", "loss", "tokens")
    return found.select(*(F.round(c, 9).alias(c) for c in ("token_nll", "target_nll", "key_nll")), "n_targets", "n_keys")


@query(
    "lr_schedule",
    """
SELECT o_orderkey % 2000 AS u, round(CASE WHEN o_orderkey % 2000 < 100 THEN (o_orderkey % 2000 + 1) / 100.0::DOUBLE
  ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * least(greatest((o_orderkey % 2000 - 100) / 900.0::DOUBLE, 0), 1))) END, 9) AS scale, count(*) AS n_rows
FROM orders GROUP BY 1, 2
""",
)
def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("o_orderkey") % 2000
    rows = table(spark, sf_dir, "orders").select(u.alias("u"))
    return rows.groupBy("u").agg(F.count("*").alias("n_rows")).select("u", F.round(numbers.learning_rate_scale(F.col("u"), 100, 1000, 1e-3, 1e-4), 9).alias("scale"), "n_rows")


@query("perplexity", "SELECT event_type, round(exp(least(avg(value) / 10, 20)), 6) AS perplexity FROM events GROUP BY event_type")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(numbers.perplexity(F.avg("value") / 10), 6).alias("perplexity"))


@query("revision_check", "SELECT page_id, regexp_matches(substr(sha256(url), 1, 40 - page_id % 2), '^[0-9a-f]{40}$') AS pinned FROM pages")
def revision_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = sha256(F.col("url"))
    revision = F.when(F.col("page_id") % 2 == 0, F.substring(digest, 1, 40)).otherwise(F.substring(digest, 1, 39))
    return table(spark, sf_dir, "pages").select("page_id", is_revision(revision).alias("pinned"))


@query(
    "prompt_leakage",
    """
SELECT conv_id, turn, (position('the ' IN text) > 0) OR (length(text) - length(replace(text, '.', ''))) <> 1 AS leaks FROM conversations
""",
)
def prompt_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.leaks_instruction(F.col("text"), "the ", ".").alias("leaks"))


@query(
    "index_in_name",
    """
SELECT d.doc_id, b.item_id, sha256(b.text) AS item_sha256 FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % 50
""",
)
def index_in_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents named after an item, and that item: the number behind the name's last hyphen is its place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", evaluation.index_in_name(F.concat(F.lit("item-x-"), (F.col("doc_id") % 50).cast("string"))).alias("at"))
    items = table(spark, sf_dir, "benchmark").select("item_id", sha256(F.col("text")).alias("item_sha256"))
    return docs.join(items, F.col("at") == F.col("item_id")).select("doc_id", "item_id", "item_sha256")


@query(
    "normalise_shapes",
    """
SELECT 'letters' AS shape, 'q' || item_id AS sample_id, 'ask ' || item_id AS question, 'one|two' AS choices, 'a/' || item_id || '.wav' AS audio FROM benchmark
UNION ALL SELECT 'map', 'clip' || item_id || '.FLAC', 'ask ' || item_id, 'x|z', 'clip' || item_id || '.FLAC' FROM benchmark
UNION ALL SELECT 'none', sha256('{"choice_a":"unused","choices":[],"question":"ask ' || item_id || '"}'), 'ask ' || item_id, '', NULL FROM benchmark
""",
)
def normalise_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark rows of three further shapes: lettered choices and audio as a struct, choices as a map, and no id, choices or audio."""
    items = table(spark, sf_dir, "benchmark")
    n = F.col("item_id").cast("string")
    ask = F.concat(F.lit("\n ask "), n, F.lit("\t"))
    none = F.array().cast("array<string>")
    shapes = {
        "letters": items.select(F.concat(F.lit("q"), n).alias("question_id"), F.lit(" ").alias("question"), ask.alias("prompt"), F.lit("one").alias("choice_a"), F.lit(" ").alias("choice_b"), F.lit("two").alias("choice_c"), F.struct(F.lit(b"").alias("bytes"), F.concat(F.lit("a/"), n, F.lit(".wav")).alias("path")).alias("audio")),
        "map": items.select(n.alias("uid"), ask.alias("text"), F.create_map(F.lit("A"), F.lit("x"), F.lit("B"), F.lit(""), F.lit("C"), F.lit("z")).alias("options"), F.concat(F.lit("clip"), n, F.lit(".FLAC")).alias("audio_id")),
        "none": items.select(F.concat(F.lit("ask "), n).alias("question"), none.alias("choices"), F.lit("unused").alias("choice_a")),
    }
    parts = []
    for shape, raw in shapes.items():
        rows = evaluation.normalised(raw)
        parts.append(rows.select(F.lit(shape).alias("shape"), "sample_id", "question", F.array_join("choices", "|").alias("choices"), F.col("audio")[0].alias("audio")))
    return parts[0].union(parts[1]).union(parts[2])

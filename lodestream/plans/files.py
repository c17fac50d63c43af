"""Queries that write files of each kind, made of the driver's tables, and read them back."""

from __future__ import annotations

import io
import os
import tarfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.audio import MOST_IN_HEADER
from ..functions.hashing import sha256
from ..operators import catalog, evaluation, metrics, overlay
from ..operators.dispatch import scorer_commands
from ..sources import logs, manifests, shards, sidecars, sinks, tar
from ..sources.tables import catalog_path, scan, shared_dir, table
from ..streaming.follow import follow
from .registry import query, strip_sql

SHARD_ROWS = 200


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestream-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _local(path: str) -> str:
    """The path as open() takes it."""
    return path.removeprefix("file://")


@query("catalog_layouts", "SELECT doc_id, n_chars FROM documents")
def catalog_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog written in the second of its layouts, found and read."""
    root = _scratch(spark, "catalogs")
    table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").write.parquet(f"{root}/catalog/corpus/audio")
    return scan(spark, catalog_path(spark, root, "corpus", "audio"), ["doc_id", "n_chars"])


@query("json_durations", "SELECT CASE WHEN n_chars % 2 = 0 THEN 'even' ELSE 'odd' END AS split, CAST(doc_id AS VARCHAR) AS id, n_chars / 64.0::DOUBLE AS duration_seconds FROM documents")
def json_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations in files that each hold an array of at most SHARD_ROWS objects."""
    root = _scratch(spark, "durations")
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") % 2 == 0, "even").otherwise("odd").alias("split"), F.floor(F.col("doc_id") / SHARD_ROWS).alias("part"), F.struct(F.col("doc_id").cast("string").alias("id"), (F.col("n_chars") / F.lit(64.0)).alias("duration")).alias("x"))
    rows = docs.groupBy("split", "part").agg(F.to_json(F.struct(F.collect_list("x").alias("data"))).alias("value"))
    rows.repartition("split", "part").sortWithinPartitions("split", "part").select("split", "value").write.option("maxRecordsPerFile", 1).partitionBy("split").text(root)
    return logs.nested_durations(spark, {x: f"{root}/split={x}" for x in ("even", "odd")})


@query(
    "source_targets",
    f"SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS target_id, role AS target_type, sha256(text) AS text_sha256 FROM conversations WHERE role IN ('user', 'assistant') AND {strip_sql('text')} <> ''",
)
def source_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as targets of two types."""
    found = overlay.source_targets(_targets(spark, sf_dir), ["user", "assistant"])
    return found.select("target_id", "target_type", sha256(F.col("text")).alias("text_sha256"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter(F.regexp_like("text", F.lit("\\S")))
    key = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return turns.select(F.col("conv_id").cast("string").alias("audio_id"), key.alias("target_id"), F.col("role").alias("target_type"), "text", F.lit("dev").alias("split"))


def _header(rate: Column, channels: Column, samples: Column) -> Column:
    """The first 42 bytes of a FLAC file; a count that their 36 bits can't hold is 0, which says that it is unknown."""
    samples = F.when(samples.between(0, MOST_IN_HEADER), samples).otherwise(0).cast("long")

    def number(value: Column, digits: int) -> Column:
        return F.lpad(F.hex(value.cast("long")), digits, "0")

    low = samples.bitwiseAND(F.lit((1 << 32) - 1))
    high = F.shiftleft(rate.cast("long"), 12) + F.shiftleft(channels.cast("long") - 1, 9) + F.lit(15 << 4).cast("long") + F.shiftrightunsigned(samples, 32)
    return F.unhex(F.concat(F.lit("664C614300000022"), F.lit("00" * 10), number(high, 8), number(low, 8), F.lit("00" * 16)))


def _shards(spark: SparkSession, sf_dir: str, faulty: bool = False) -> tuple[str, DataFrame]:
    """A folder of TAR shards of at most SHARD_ROWS documents each, and their catalog."""
    root = _scratch(spark, "shards")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("audio_id"), F.concat(F.lit("s"), F.floor(F.col("doc_id") / SHARD_ROWS).cast("string"), F.lit(".tar")).alias("wds_shard"), F.coalesce("text", F.lit("")).alias("text"), F.col("n_chars").cast("long").alias("n_chars"))

    def odd(n: int) -> Column:
        return (F.col("doc_id") % n == 0) & F.lit(faulty)

    samples = F.when(F.col("doc_id") % 10 > 1, F.col("n_chars") * 160).otherwise(0)
    header = _header(F.when(odd(3), 44100).otherwise(16000), F.when(odd(11), 2).otherwise(1), samples)
    whole = F.concat(header, F.col("text").cast("binary"))
    meta = F.to_json(F.struct(F.when(odd(5), "other").otherwise(F.col("audio_id")).alias("id")))
    rows = docs.select("doc_id", "audio_id", "wds_shard", "n_chars", whole.alias("flac"), meta.alias("json"))
    folder = _local(root)
    os.makedirs(folder, exist_ok=True)

    def write(frame: pd.DataFrame) -> pd.DataFrame:
        name = frame["wds_shard"].iloc[0]
        with tarfile.open(f"{folder}/{name}.part", "w") as archive:
            for r in frame.sort_values("doc_id").itertuples(index=False):
                for suffix, data in (("flac", bytes(r.flac)), ("json", r.json.encode())):
                    member = tarfile.TarInfo(f"{r.audio_id}.{suffix}")
                    member.size = len(data)
                    archive.addfile(member, io.BytesIO(data))
        os.replace(f"{folder}/{name}.part", f"{folder}/{name}")
        return pd.DataFrame({"wds_shard": [name], "n_rows": [len(frame)]})

    rows.select("doc_id", "audio_id", "wds_shard", "flac", "json").groupBy("wds_shard").applyInPandas(write, "wds_shard string, n_rows long").write.format("noop").mode("overwrite").save()
    digest = F.when(odd(7), F.lit("0" * 64)).otherwise(F.sha2("flac", 256))
    return root, rows.select("audio_id", "wds_shard", F.col("audio_id").alias("wds_key"), F.length("flac").cast("long").alias("flac_size"), digest.alias("flac_sha256"), "n_chars")


def _indexed(spark: SparkSession, root: str, audio: DataFrame) -> DataFrame:
    names = [r[0] for r in audio.select("wds_shard").distinct().collect()]  # shards, not samples
    return tar.sample_index(tar.members(spark, _local(root), names))


_TAR_SQL = f"""
d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS audio_id, doc_id // {SHARD_ROWS} AS shard, n_chars, 42 + octet_length(encode(coalesce(text, ''))) AS flac_size, 9 + length(CAST(doc_id AS VARCHAR)) AS json_size FROM documents),
p AS (SELECT *, (flac_size + 511) // 512 * 512 AS f, (json_size + 511) // 512 * 512 AS j FROM d),
t AS (SELECT *, CAST(coalesce(sum(1024 + f + j) OVER (PARTITION BY shard ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p)
"""


@query(
    "tar_sample_index",
    f"""
WITH {_TAR_SQL}
SELECT audio_id, start + 512 AS flac_offset, start + 1024 + f AS json_offset, json_size,
  CAST(CASE WHEN doc_id % 10 = 1 OR n_chars = 0 THEN 0 ELSE n_chars * 160 END AS BIGINT) AS num_samples,
  CASE WHEN n_chars = 0 OR doc_id % 10 = 1 THEN 'flac_empty' WHEN doc_id % 10 = 0 THEN 'libsndfile_header' ELSE 'flac_streaminfo' END AS num_samples_source FROM t
""",
)
def tar_sample_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of shards, joined to the catalog: byte ranges, and counts from headers or from a probe."""
    root, audio = _shards(spark, sf_dir)
    probed = audio.filter("cast(audio_id as long) % 10 = 0").select("audio_id", (F.col("n_chars") * 160).alias("frames"))
    found = tar.exact_samples(audio, _indexed(spark, root, audio), probed)
    return found.select("audio_id", "flac_offset", "json_offset", "json_size", "num_samples", "num_samples_source")


@query("payload_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS audio_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents")
def payload_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads read by byte range from their shards."""
    root, audio = _shards(spark, sf_dir)
    planned = tar.exact_samples(audio, _indexed(spark, root, audio))
    found = sidecars.read_payloads(planned, _local(root))
    return found.select("audio_id", F.sha2(F.substring("flac", 43, 1 << 30), 256).alias("text_sha256"))


@query(
    "payload_faults",
    """
SELECT CAST(doc_id AS VARCHAR) AS audio_id, CASE WHEN doc_id % 5 = 0 THEN 'key' WHEN doc_id % 7 = 0 THEN 'digest' WHEN doc_id % 3 = 0 THEN 'rate' ELSE 'channels' END AS fault
FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0 OR doc_id % 3 = 0 OR doc_id % 11 = 0
""",
)
def payload_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads some of whose names, digests, rates or channels aren't what the catalog says."""
    root, audio = _shards(spark, sf_dir, faulty=True)
    index = _indexed(spark, root, audio).select(F.col("shard").alias("wds_shard"), F.col("key").alias("wds_key"), "flac_offset", "json_offset", "json_size")
    return sidecars.payload_faults(sidecars.read_payloads(audio.join(index, ["wds_shard", "wds_key"]), _local(root)))


@query(
    "mirror_totals",
    f"""
WITH {_TAR_SQL}, s AS (SELECT shard, (sum(1024 + f + j) + 1024 + 10239) // 10240 * 10240 AS n FROM t GROUP BY shard)
SELECT count(*) AS shard_count, CAST(sum(n) AS BIGINT) AS total_bytes, count(*) AS complete, 0::BIGINT AS complete_of_another FROM s
""",
)
def mirror_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mirror marked as whole, found whole, and not taken for another dataset's."""
    root, audio = _shards(spark, sf_dir)
    names = [r[0] for r in audio.select("wds_shard").distinct().collect()]  # shards, not samples
    made = shards.mark(spark, _local(root), "corpus", names)
    found = [shards.complete(spark, _local(root), x, names) for x in ("corpus", "other")]
    return spark.createDataFrame([(made["shard_count"], made["total_bytes"], len(found[0] or []), len(found[1] or []))], "shard_count long, total_bytes long, complete long, complete_of_another long")


_SIDE = "CAST(doc_id AS VARCHAR) AS audio_id, CAST(n_chars AS BIGINT) * 160 AS num_samples, CAST(n_chars AS BIGINT) * 160 / 16000.0::DOUBLE AS duration_seconds, sha256(coalesce(text, '')) AS flac_sha256"


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("audio_id"), "source", sha256(F.coalesce("text", F.lit(""))).alias("flac_sha256"), F.col("n_chars").cast("long").alias("n_chars"))


@query("sidecar_join", f"SELECT audio_id, source, num_samples, duration_seconds FROM (SELECT source, {_SIDE} FROM documents)")
def sidecar_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts written as a sidecar, loaded under its contract and joined by digest."""
    rows, path = _catalog(spark, sf_dir), _scratch(spark, "sidecar")
    counts = sidecars.from_samples(rows.select("audio_id", (F.col("n_chars") * 160).alias("num_samples"), "flac_sha256"))
    sidecars.write(counts, path, rows.count())
    return sidecars.with_durations(rows.drop("n_chars"), sidecars.load(spark, path)).select("audio_id", "source", "num_samples", "duration_seconds")


@query(
    "exact_sidecar",
    f"""
WITH {_TAR_SQL}
SELECT audio_id, CAST(n_chars AS BIGINT) * 160 AS num_samples, start + 512 AS flac_offset, flac_size FROM t WHERE doc_id % 10 > 1 AND n_chars > 0
""",
)
def exact_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact sidecar of shards: written, loaded with its sources and byte ranges, joined, and cut to rows with samples."""
    root, audio = _shards(spark, sf_dir)
    path = _scratch(spark, "exact")
    exact = tar.exact_samples(audio, _indexed(spark, root, audio)).drop("header", "n_chars")
    sidecars.write(sidecars.from_samples(exact), path, audio.count())
    loaded = sidecars.load(spark, path, exact=True)
    joined = sidecars.with_durations(audio.select("audio_id", "wds_shard", "wds_key", "flac_size", "flac_sha256"), loaded, exact=True)
    return sidecars.usable(joined).select("audio_id", "num_samples", "flac_offset", "flac_size")


@query("estimated_durations", "SELECT CAST(doc_id AS VARCHAR) AS audio_id, CAST(round_even(n_chars / 37.0::DOUBLE * 16000, 0) AS BIGINT) AS num_samples, n_chars / 37.0::DOUBLE AS duration_seconds FROM documents")
def estimated_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecar rows from durations given upstream by source and id."""
    rows = _catalog(spark, sf_dir)
    durations = rows.select("audio_id", "source", (F.col("n_chars") / F.lit(37.0)).alias("duration_seconds"))
    return sidecars.estimated(rows, durations, ["audio_id", "source"]).select("audio_id", "num_samples", "duration_seconds")


@query("benchmark_files", "SELECT item_id, sha256(text) AS text_sha256, 'jsonl' AS kind FROM benchmark UNION ALL SELECT item_id, sha256(text), 'parquet' FROM benchmark")
def benchmark_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark's rows as Parquet in its subset's folder and as JSON lines at the root."""
    items, parts = table(spark, sf_dir, "benchmark").select("item_id", "text"), []
    for kind in ("parquet", "jsonl"):
        root = _scratch(spark, f"benchmark-{kind}")
        if kind == "parquet":
            items.write.parquet(f"{root}/hard")
        else:
            items.write.json(f"{root}/lines")
            _gathered(f"{_local(root)}/lines", f"{_local(root)}/hard.jsonl")
        rows = logs.benchmark_rows(spark, logs.candidate_files(_local(root), "hard"))
        parts.append(rows.select("item_id", sha256(F.col("text")).alias("text_sha256"), F.lit(kind).alias("kind")))
    return parts[0].union(parts[1])


def _gathered(folder: str, path: str) -> None:
    """The parts of a folder as one file, copied in blocks."""
    with open(path, "wb") as out:
        for name in sorted(os.listdir(folder)):
            if name.startswith("part-"):
                with open(f"{folder}/{name}", "rb") as part:
                    while block := part.read(1 << 20):
                        out.write(block)


def _log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of prediction logs, a file for each thousand of them."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.floor(F.col("event_id") / 1000).cast("long").alias("part"))
    record = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.col("event_id").alias("row_index"), F.col("event_type").alias("prediction")))
    failed = F.to_json(F.struct(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.lit(None).cast("string").alias("error")), {"ignoreNullFields": "false"})
    return events.select("part", "event_id", F.when(F.col("event_type") == "error", failed).otherwise(record).alias("value"))


def _logs(spark: SparkSession, sf_dir: str) -> str:
    path = _scratch(spark, "log")
    rows = _log_lines(spark, sf_dir)
    rows.repartition("part").sortWithinPartitions("part", "event_id").select("part", "value").write.partitionBy("part").text(path)
    return path


@query(
    "prediction_log",
    """
SELECT 'u' || user_id AS id, CASE WHEN event_type <> 'error' THEN event_id END AS row_index, CASE WHEN event_type <> 'error' THEN event_type END AS prediction, event_type = 'error' AS failed, count(*) AS n_rows
FROM events GROUP BY ALL
""",
)
def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs read as predictions; an error is told by its key, though its value is null."""
    found = logs.predictions(spark, _logs(spark, sf_dir))
    return found.groupBy("id", "row_index", "prediction", "failed").agg(F.count("*").alias("n_rows"))


@query("log_line_numbers", "SELECT event_id // 1000 AS part, row_number() OVER (PARTITION BY event_id // 1000 ORDER BY event_id) - 1 AS line, event_id AS row_index FROM events QUALIFY event_type <> 'error'")
def log_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each line in its file."""
    found = logs.numbered(logs.lines(spark, _logs(spark, sf_dir)))
    part = F.regexp_extract("file", "part=([0-9]+)/", 1).cast("long")
    rows = found.select(part.alias("part"), "line", F.get_json_object("value", "$.row_index").cast("long").alias("row_index"))
    return rows.filter("row_index is not null")


@query(
    "scorer_log_last",
    """
SELECT 'last_match' AS kind, arg_max(CAST(value AS VARCHAR), event_id) AS found FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS value FROM events WHERE event_type = 'purchase')
UNION ALL SELECT 'last_result', CAST(max(event_id) AS VARCHAR) FROM events WHERE event_type = 'click'
""",
)
def scorer_log_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last match of a pattern, and the last result, of a scorer's log."""
    path = _scratch(spark, "scorer-log")
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    line = F.when(kind == "purchase", F.concat(F.lit("accuracy = "), F.floor("value").cast("string"), F.lit(" of 100")))
    line = line.when(kind == "click", F.concat(F.lit("12:00 | INFO | done - {'seen': "), n, F.lit(", 'other': None}"))).otherwise("")
    # A log is one file, which one task writes.
    table(spark, sf_dir, "events").orderBy("event_id").select(line.alias("value")).coalesce(1).write.text(path)
    log = logs.lines(spark, path)
    match = logs.last_match(log, "accuracy = (-?[0-9]+) of", ["found"]).select(F.lit("last_match").alias("kind"), "found")
    return match.union(logs.last_result(log).select(F.lit("last_result"), F.col("result")["seen"]))


@query(
    "score_tree",
    """
WITH s AS (SELECT source AS subset, avg(n_chars) / 1000 AS value, count(*) AS n FROM documents GROUP BY source)
SELECT subset, 'accuracy' AS metric, round(value, 9) AS value, n FROM s
UNION ALL SELECT 'all', 'weighted', round(sum(value * n) / sum(n), 9), CAST(sum(n) AS BIGINT) FROM s
""",
)
def score_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scores file for each source, read with the source's name, and their mean weighted by counts."""
    from ..functions.numbers import weighted_mean

    root = _local(_scratch(spark, "scores"))
    found = table(spark, sf_dir, "documents").groupBy("source").agg((F.avg("n_chars") / 1000).alias("value"), F.count("*").alias("n")).collect()  # sources, not rows
    for r in found:
        shards.write_json(f"{root}/{r['source']}/scoring/scores.json", {"aggregate_metrics": {"accuracy": {"value": r["value"], "count": r["n"]}}})
    tree = logs.score_tree(spark, root)
    total = tree.agg(F.lit("all").alias("subset"), F.lit("weighted").alias("metric"), weighted_mean(F.col("value"), F.col("n")).alias("value"), F.sum("n").alias("n"))
    return tree.union(total).select("subset", "metric", F.round("value", 9).alias("value"), "n")


_HEX = "0123456789abcdef" * 2 + "01234567"
_MANIFEST = {
    "benchmarks": {
        "alpha": {"dataset_id": "x/alpha", "revision": _HEX, "subsets": ["one", "two"], "split": "test", "question_mode": "text_question", "official_format": "mmsu_jsonl", "audio_patterns": ["*"], "scorer_repo": "x/s", "scorer_revision": _HEX, "judge_provider": "p", "judge_model": "m", "judge_subsets": ["two"]},
        "beta": {"dataset_id": "x/beta", "revision": _HEX, "split": "dev", "question_mode": "audio_only", "official_format": "mmau_json", "audio_patterns": ["*"], "scorer_repo": "x/s", "scorer_revision": _HEX},
    },
    "profiles": {"base": {"revision": _HEX, "references": {"EUROPE": {"expected": 0, "minimum": -1000, "maximum": 1000}, "ASIA": {"expected": 5000, "minimum": 4000, "maximum": 9000}, "ATLANTIS": {"expected": 1, "minimum": 0, "maximum": 2}}}},
}


def _manifest(spark: SparkSession) -> str:
    path = f"{_local(_scratch(spark, 'manifest'))}/benchmarks.yaml"
    shards.write_json(path, _MANIFEST)  # JSON is YAML
    return path


@query(
    "benchmark_selection",
    "SELECT * FROM (VALUES ('alpha', 'two', 'mmsu_jsonl', 'score-mmsu', TRUE), ('beta', 'default', 'mmau_json', 'score-mmau', FALSE)) AS t(name, subset, official_format, command, judged)",
)
def benchmark_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmarks of a manifest, chosen by name and subset, with the command that scores each."""
    specs = manifests.benchmark_specs(spark, _manifest(spark))
    commands = scorer_commands(specs, {"mmsu_jsonl": "score-mmsu", "mmau_json": "score-mmau"})
    judged = specs.select("name", F.explode_outer("judge_subsets").alias("judged_subset"))
    found = manifests.selected(specs, ["alpha:two", "beta"]).join(commands, ["name", "subset"]).join(judged, "name")
    return found.select("name", "subset", "official_format", "command", F.coalesce(F.col("judged_subset") == F.col("subset"), F.lit(False)).alias("judged"))


@query(
    "profile_check",
    """
WITH p(metric, minimum, maximum) AS (VALUES ('EUROPE', -1000.0::DOUBLE, 1000.0::DOUBLE), ('ASIA', 4000.0, 9000.0), ('ATLANTIS', 0.0, 2.0)),
s AS (SELECT r_name AS metric, round(avg(c_acctbal), 6) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name)
SELECT metric, value, CASE WHEN value IS NULL THEN 'missing' WHEN value BETWEEN minimum AND maximum THEN 'pass' ELSE 'fail' END AS status FROM p LEFT JOIN s USING (metric)
""",
)
def profile_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary of scores, written and read, against a profile of the manifest."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    scores = {r["r_name"]: r["value"] for r in joined.groupBy("r_name").agg(F.round(F.avg("c_acctbal"), 6).alias("value")).collect()}  # regions
    path = f"{_local(_scratch(spark, 'summary'))}/summary.json"
    shards.write_json(path, scores)
    profile = manifests.profile_ranges(spark, _manifest(spark)).filter("profile = 'base'")
    return metrics.range_check(manifests.score_summary(spark, path), profile).select("metric", "value", "status")


@query(
    "validation_follow",
    """
WITH u AS (SELECT event_id // 500 AS update, round(avg(value), 6) AS nll FROM events GROUP BY 1 HAVING avg(value) IS NOT NULL)
SELECT update, nll, min(nll) OVER (ORDER BY update ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM u
""",
)
def validation_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that appear in a folder in two goes, followed as a stream with the best so far."""
    folder, state = _scratch(spark, "results"), _scratch(spark, "follow")
    rows = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 500).cast("long").alias("update")).agg(F.round(F.avg("value"), 6).alias("nll")).filter("nll is not null")
    for half in (rows.filter("update % 2 = 0"), rows.filter("update % 2 = 1")):
        half.repartition("update").write.mode("append").option("maxRecordsPerFile", 1).json(folder)
        out = follow(spark, folder, state)
    return out


@query("prediction_parts", "SELECT CAST(doc_id AS VARCHAR) AS audio_id, upper(lang) AS prediction FROM documents")
def prediction_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions appended in two goes as parts and as JSON lines, the second go being what the first left."""
    path = _scratch(spark, "predictions")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("audio_id"), F.upper("lang").alias("prediction"))
    sinks.write_predictions(rows.filter("length(audio_id) % 2 = 0"), path, "audio_id")
    done = sinks.completed_keys(spark.read.parquet(f"{path}/parquet"), "audio_id")
    sinks.write_predictions(evaluation.pending(rows, done, "audio_id"), path, "audio_id")
    sinks.completed_keys(spark.read.parquet(f"{path}/parquet"), "audio_id")
    lines = spark.read.text(f"{path}/json")
    return lines.select(F.get_json_object("value", "$.audio_id").alias("audio_id"), F.get_json_object("value", "$.prediction").alias("prediction"))


_RECIPE = "make=upper"


@query(
    "overlay_expansion",
    f"""
WITH t AS (SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS official, text FROM conversations WHERE role = 'assistant' AND regexp_matches(text, '\\S'))
SELECT official AS official_target_id, 'response-' || substr(sha256(official || chr(0) || '{_RECIPE}'), 1, 24) AS target_id, sha256({strip_sql('text')}) AS text_sha256, length(text) > 100 AS truncated, CAST(length(text) AS BIGINT) AS generated_token_count FROM t
""",
)
def overlay_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts made for targets in two goes: the first ones by id, then what is left; each part is appended once."""

    def make(texts: list[str]) -> list[tuple[str, str, int]]:
        return [(t, "length" if len(t) > 100 else "stop", len(t)) for t in texts]

    path = _scratch(spark, "overlay")
    targets = overlay.source_targets(_targets(spark, sf_dir), ["assistant"])
    overlay.expand(targets, make, path, _RECIPE, limit=50)
    out = overlay.expand(targets, make, path, _RECIPE)
    return out.select("official_target_id", "target_id", sha256(F.col("text")).alias("text_sha256"), "truncated", "generated_token_count")


@query(
    "redacted_lines",
    """
SELECT CAST(c_custkey AS VARCHAR) AS id, '<redacted>' AS token, '<redacted>' AS inner_secret, c_mktsegment AS inner_segment FROM customer
""",
)
def redacted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows appended as JSON with what names speak of as secret blotted out, at any depth."""
    path = _scratch(spark, "redacted")
    inner = F.struct(F.col("c_name").alias("api_secret"), F.col("c_mktsegment").alias("segment"))
    logs.append_redacted(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("auth_token"), inner.alias("inner")), path)
    lines = spark.read.text(path)
    return lines.select(*(F.get_json_object("value", p).alias(n) for n, p in (("id", "$.id"), ("token", "$.auth_token"), ("inner_secret", "$.inner.api_secret"), ("inner_segment", "$.inner.segment"))))


@query(
    "scorer_inputs",
    """
WITH e AS (SELECT event_id, 'u' || event_id AS id, event_type AS prediction FROM events)
SELECT id, 'mmsu' AS kind, prediction AS output, 'q' AS question FROM e UNION ALL SELECT id, 'mmau', prediction, 'q' FROM e
UNION ALL SELECT id, 'keval', prediction, NULL FROM e UNION ALL SELECT id, 'truth', NULL, 'q' FROM e UNION ALL SELECT NULL, 'jamc-qa', prediction, NULL FROM e
""",
)
def scorer_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as the lines that scorers take, written and read."""
    events = table(spark, sf_dir, "events")
    record = F.to_json(F.struct(F.lit("old").alias("id"), F.lit("q").alias("question"), F.lit('{"level":"easy"}').alias("other_attributes"), F.lit("old").alias("response"), F.lit("A").alias("answer_choice"), F.lit("c").alias("category")))
    rows = events.select(F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("prediction"), record.alias("source_record"))
    rows = rows.withColumn("source_record", F.to_json(evaluation.merged_record(F.col("source_record"), id=F.col("id"))))
    kinds = {"mmsu": (logs.scorer_input(rows, "mmsu_jsonl"), "response"), "mmau": (logs.scorer_input(rows, "mmau_json"), "model_output"), "keval": (logs.scorer_input(rows, "keval_jsonl"), "prediction"), "truth": (logs.ground_truth(rows), "prediction"), "jamc-qa": (logs.scorer_input(rows, "flexeval_jsonl", "jamc-qa"), "lm_output")}
    parts = []
    for kind, (lines, output) in kinds.items():
        path = _scratch(spark, f"scorer-{kind}")
        logs.write_lines(lines, path)
        found = spark.read.text(path)
        parts.append(found.select(F.get_json_object("value", "$.id").alias("id"), F.lit(kind).alias("kind"), F.get_json_object("value", f"$.{output}").alias("output"), F.get_json_object("value", "$.question").alias("question")))
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


@query("committed_ids", "SELECT CAST(doc_id AS VARCHAR) AS audio_id FROM documents WHERE lang = 'en'")
def committed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Committed ids saved as sorted lines and loaded."""
    path = _scratch(spark, "ids")
    logs.save_ids(table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").cast("string").alias("audio_id")), path)
    return logs.load_ids(spark, path)


@query("release_files", "SELECT 'pages/' || page_id || '.html' AS path, octet_length(encode(html)) AS n_bytes, sha256(html) AS sha256 FROM pages")
def release_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release's files, their sizes and digests."""
    root = _local(_scratch(spark, "release"))
    os.makedirs(f"{root}/pages")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                with open(f"{root}/pages/{r.page_id}.part", "wb") as file:
                    file.write(r.html.encode())
                os.replace(f"{root}/pages/{r.page_id}.part", f"{root}/pages/{r.page_id}.html")
            yield frame[["page_id"]]

    table(spark, sf_dir, "pages").select("page_id", "html").mapInPandas(write, "page_id long").write.format("noop").mode("overwrite").save()
    return shards.release_manifest(spark, root, "*.html")


@query(
    "metric_lines",
    "SELECT event_id AS update, value AS nll, round(exp(least(value, 20)), 2) AS perplexity, event_type AS kind FROM events WHERE value IS NOT NULL",
)
def metric_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements appended as lines and read."""
    path = _scratch(spark, "metrics")
    sinks.append_metrics(table(spark, sf_dir, "events").filter("value is not null").select(F.col("event_id").alias("update"), F.col("value").alias("nll"), F.col("event_type").alias("kind")), path)
    found = spark.read.text(path).select(F.from_json("value", "update long, nll double, perplexity double, kind string").alias("m")).select("m.*")
    return found.select("update", "nll", F.round("perplexity", 2).alias("perplexity"), "kind")


@query(
    "wav_headers",
    """
SELECT vec_id, 36 + 2 * len(embedding) AS riff_size, 16000::BIGINT AS rate, 2 * len(embedding) AS n_bytes,
  CAST(round_even(greatest(-1, least(1, (CAST(embedding[1] AS DOUBLE) + CAST(embedding[1] AS DOUBLE) / 2) / 2)) * 32767, 0) AS BIGINT) AS first_level FROM embeddings
""",
)
def wav_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels of vectors as one in WAV, and what its header and its first sample say."""
    v = F.col("embedding").cast("array<double>")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.array(v, F.transform(v, lambda x: x / 2)).alias("channels"))
    raw = F.hex(F.unbase64(F.substring_index("uri", ",", -1)))

    def number(at: int, size: int) -> Column:
        return F.conv(F.concat(*(F.substring(raw, 2 * (at + k) + 1, 2) for k in reversed(range(size)))), 16, 10).cast("long")

    level = F.when(number(44, 2) > 32767, number(44, 2) - 65536).otherwise(number(44, 2))
    return sinks.wav_uri(rows, "channels", 16000).select("vec_id", number(4, 4).alias("riff_size"), number(24, 4).alias("rate"), number(40, 4).alias("n_bytes"), level.alias("first_level"))


@query("content_store", "SELECT sha256(coalesce(text, '')) AS digest, octet_length(encode(any_value(coalesce(text, '')))) AS n_bytes, 1::BIGINT AS copies, count(*) AS n_rows FROM documents GROUP BY 1")
def content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts kept once each under their digest, in two goes over the same rows, and how many rows point at each."""
    path = _scratch(spark, "contents")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    sinks.keep_content(docs.filter("doc_id % 2 = 0"), path, "text")
    marked = sinks.keep_content(docs, path, "text")
    kept = spark.read.parquet(path).groupBy("digest").agg(F.max(F.length("content")).cast("long").alias("n_bytes"), F.count("*").alias("copies"))
    return kept.join(marked.groupBy("digest").agg(F.count("*").alias("n_rows")), "digest")


@query("unpack_safely", "SELECT CASE WHEN page_id % 4 = 0 THEN '../' WHEN page_id % 4 = 1 THEN '/' ELSE '' END || 'p' || page_id AS name, page_id % 4 = 3 AS safe FROM pages")
def unpack_safely(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which members of an archive may be unpacked."""
    n = F.col("page_id") % 4
    name = F.concat(F.when(n == 0, "../").when(n == 1, "/").otherwise(""), F.lit("p"), F.col("page_id").cast("string"))
    return shards.safe_members(table(spark, sf_dir, "pages").select(name.alias("name"), (n == 2).alias("is_link")))


@query(
    "manifest_guards",
    "SELECT * FROM (VALUES ('config', 'a.x=1 a.y=3 b=2'), ('differing', 'seed'), ('first', 'written'), ('other', 'refused'), ('same', 'kept')) AS t(step, outcome)",
)
def manifest_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest is written once, kept when equal and refused when not; a configuration extends another."""
    from ..sources.tables import ContractError

    folder, out = _local(_scratch(spark, "manifests")), []
    for step, manifest in (("first", {"seed": 1, "n": 2}), ("same", {"n": 2, "seed": 1}), ("other", {"seed": 2, "n": 2})):
        there = os.path.exists(f"{folder}/manifest.json")
        try:
            shards.require_same_manifest(f"{folder}/manifest.json", manifest)
            out.append((step, "kept" if there else "written"))
        except ContractError:
            out.append((step, "refused"))
    out.append(("differing", ",".join(manifests.differing({"seed": 1, "n": 2}, {"seed": 2, "n": 2}, ["n", "seed"]))))
    shards.write_json(f"{folder}/base.yaml", {"a": {"x": 1, "y": 2}, "b": 2})
    shards.write_json(f"{folder}/own.yaml", {"extends": "base.yaml", "a": {"y": 3}})
    found = manifests.load_config(f"{folder}/own.yaml")
    out.append(("config", f"a.x={found['a']['x']} a.y={found['a']['y']} b={found['b']}"))
    return spark.createDataFrame(out, "step string, outcome string")


@query("audio_and_target_rows", "SELECT count(*) AS n_rows, count(*) FILTER (lang IS NULL) AS without_splits, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS n_bytes, count(*) FILTER (source = 'src0') AS without_generator FROM documents")
def audio_and_target_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows in their types: no splits are an empty list, empty provenance is null."""
    docs, key = table(spark, sf_dir, "documents"), F.col("doc_id").alias("audio_id")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("string")
    audio = catalog.audio_rows(docs.select(key, F.lit("d").alias("dataset"), F.lit("h").alias("flac_sha256"), size.alias("flac_size"), F.lit("s").alias("source_id"), F.lit(1).alias("target_count"), F.lit("k").alias("wds_key"), F.lit("w").alias("wds_shard"), F.when(F.col("lang").isNotNull(), F.array("lang")).alias("splits")))
    model = F.when(F.col("source") == "src0", "").otherwise("m")
    targets = catalog.target_rows(docs.select(key, F.col("doc_id").alias("target_id"), F.lit("t").alias("target_type"), "text", F.lit("dev").alias("split"), "source", model.alias("generator_model"), F.lit("").alias("generator_revision"), F.lit("").alias("prompt_sha256"), F.lit(None).cast("string").alias("review_status")))
    joined = audio.join(targets, "audio_id")
    return joined.agg(F.count("*").alias("n_rows"), F.count_if(F.size("splits") == 0).alias("without_splits"), F.sum("flac_size").cast("long").alias("n_bytes"), F.count_if(F.col("generator_model").isNull() & (F.col("review_status") == "")).alias("without_generator"))

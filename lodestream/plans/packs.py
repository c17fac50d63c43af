"""Queries of lengths, orders, packs and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import audio
from ..functions.hashing import order_key
from ..functions.text import words
from ..operators import ordering, packing
from ..operators.metrics import exact_quantiles
from ..sources.tables import table
from .bridges import EPOCH, FRAMES_SQL, SEED, STACK, TOKENS_SQL, WORKERS, lengths, samples, tokens
from .registry import bucket_sql, order_sql, query

CAPACITY, SMALL_CAPACITY, WINDOW = 4096, 600, 256
GRID_CAPACITIES, GRID_WINDOWS = (2048, 4096, 8192), (64, 256)

_WORKER_SQL = bucket_sql(SEED, EPOCH, "doc_id", str(WORKERS))


def _bfd_sql(items: str) -> str:
    """Best-fit decreasing over items (g, len, rn: place by falling length): relations bins (g, used)."""
    return f"""
items AS ({items}),
step AS (
  SELECT DISTINCT g, cap, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS used FROM items
  UNION ALL
  SELECT s.g, s.cap, i.rn, CASE WHEN list_max(list_filter(used, lambda u: u + i.len <= s.cap)) IS NULL THEN list_append(used, i.len)
    ELSE list_transform(used, lambda u, k: CASE WHEN k = list_position(used, list_max(list_filter(used, lambda v: v + i.len <= s.cap))) THEN u + i.len ELSE u END) END
  FROM step s JOIN items i ON i.g = s.g AND i.cap = s.cap AND i.rn = s.rn + 1
),
bins AS (SELECT g, cap, unnest(used) AS used FROM (SELECT g, cap, arg_max(used, rn) AS used FROM step GROUP BY g, cap))
"""


_STATS_SQL = "count(*) AS n_packs, CAST(sum(used) AS BIGINT) AS tokens, round(sum(used) / (count(*) * cap), 9) AS utilisation, CAST(ceil(sum(used) / cap) AS BIGINT) AS lower_bound"

_LENGTHS_SQL = f"l AS (SELECT doc_id, source, {_WORKER_SQL} AS worker, {TOKENS_SQL} AS len FROM documents)"


@query(
    "bfd_pack_stats",
    f"""
WITH RECURSIVE {_LENGTHS_SQL},
w AS (SELECT *, (row_number() OVER (PARTITION BY worker ORDER BY doc_id) - 1) // {WINDOW} AS win FROM l),
{_bfd_sql(f"SELECT worker * 1000000 + win AS g, CAST({CAPACITY} AS BIGINT) AS cap, CAST(len AS BIGINT) AS len, row_number() OVER (PARTITION BY worker, win ORDER BY len DESC, doc_id) AS rn FROM w WHERE len <= {CAPACITY}")}
SELECT g // 1000000 AS worker, {_STATS_SQL} FROM bins GROUP BY g // 1000000, cap
""",
)
def bfd_pack_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.windows(lengths(spark, sf_dir), "worker", [F.col("doc_id")], WINDOW)
    stats = packing.pack_stats(packing.packed(rows, "worker", "length", CAPACITY), ["worker"], "worker", "length", CAPACITY)
    return stats.select("worker", "n_packs", "tokens", F.round("utilisation", 9).alias("utilisation"), "lower_bound")


@query(
    "worker_pack_totals",
    f"""
WITH RECURSIVE {_LENGTHS_SQL},
w AS (SELECT *, (row_number() OVER (PARTITION BY worker ORDER BY doc_id) - 1) // {WINDOW} AS win FROM l),
{_bfd_sql(f"SELECT worker * 1000000 + win AS g, CAST({SMALL_CAPACITY} AS BIGINT) AS cap, CAST(len AS BIGINT) AS len, row_number() OVER (PARTITION BY worker, win ORDER BY len DESC, doc_id) AS rn FROM w WHERE len <= {SMALL_CAPACITY}")},
p AS (SELECT g // 1000000 AS worker, count(*) AS n_packs, sum(used) AS tokens, ceil(sum(used) / {SMALL_CAPACITY}) AS lower_bound FROM bins GROUP BY 1)
SELECT CAST(sum(n_packs) AS BIGINT) AS n_packs, (SELECT count(*) FROM l WHERE len <= {SMALL_CAPACITY}) AS n_items, (SELECT count(*) FROM l WHERE len > {SMALL_CAPACITY}) AS n_oversized, CAST(sum(tokens) AS BIGINT) AS tokens,
  round(sum(tokens) / (sum(n_packs) * {SMALL_CAPACITY}), 9) AS utilisation, round((SELECT count(*) FROM l WHERE len <= {SMALL_CAPACITY}) / sum(n_packs), 9) AS items_per_pack, CAST(sum(lower_bound) AS BIGINT) AS lower_bound FROM p
""",
)
def worker_pack_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each worker's packs, merged: counts and bounds add up, ratios follow."""
    rows = packing.windows(lengths(spark, sf_dir), "worker", [F.col("doc_id")], WINDOW)
    each = packing.pack_stats(packing.packed(rows, "worker", "length", SMALL_CAPACITY), ["worker"], "worker", "length", SMALL_CAPACITY, rows)
    total = packing.merge_stats(each, [], F.lit(SMALL_CAPACITY))
    return total.select("n_packs", "n_items", "n_oversized", "tokens", F.round("utilisation", 9).alias("utilisation"), F.round("items_per_pack", 9).alias("items_per_pack"), "lower_bound")


@query(
    "pack_grid",
    f"""
WITH RECURSIVE {_LENGTHS_SQL},
p AS (SELECT c.cap, b.size FROM (SELECT unnest({list(GRID_CAPACITIES)}) AS cap) c, (SELECT unnest({list(GRID_WINDOWS)}) AS size) b),
f AS (SELECT l.*, cap, size, row_number() OVER (PARTITION BY cap, size ORDER BY {order_sql(SEED, EPOCH, "doc_id")}, doc_id) - 1 AS place FROM l JOIN p ON len <= cap),
{_bfd_sql("SELECT size * 1000000 + place // size AS g, CAST(cap AS BIGINT) AS cap, CAST(len AS BIGINT) AS len, row_number() OVER (PARTITION BY cap, size, place // size ORDER BY len DESC, place) AS rn FROM f")}
SELECT CAST(cap AS INTEGER) AS capacity, CAST(g // 1000000 AS INTEGER) AS size, {_STATS_SQL} FROM bins GROUP BY cap, g // 1000000
""",
)
def pack_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each capacity and window size over the shuffled corpus; here rows that are too long go before windows are laid."""
    order = [order_key(SEED, EPOCH, F.col("doc_id")), F.col("doc_id")]
    stats = packing.grid(lengths(spark, sf_dir), order, "length", list(GRID_CAPACITIES), list(GRID_WINDOWS))
    return stats.select("capacity", "size", "n_packs", "tokens", F.round("utilisation", 9).alias("utilisation"), "lower_bound")


@query(
    "encoder_frames",
    f"SELECT doc_id, n_chars * 160 AS samples, (n_chars * 160 + 159) // 160 AS mel_frames, ((n_chars * 160 + 159) // 160 + 1) // 2 AS whole_frames, {FRAMES_SQL} AS chunked_frames FROM documents",
)
def encoder_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = samples()
    mel = audio.mel_frames(n)
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("samples"), mel.alias("mel_frames"), audio.encoder_frames(mel).alias("whole_frames"), audio.chunked_encoder_frames(n).alias("chunked_frames"))


@query(
    "projected_tokens",
    f"""
SELECT doc_id, (({FRAMES_SQL}) + 3) // 4 AS audio_tokens, (({FRAMES_SQL}) + 3) // 4 + 2 AS with_boundaries, {TOKENS_SQL} AS example_tokens,
  n_chars * 160 // 512 + 1 AS dmel_frames FROM documents
""",
)
def projected_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = audio.chunked_encoder_frames(samples())
    return table(spark, sf_dir, "documents").select("doc_id", audio.projected_tokens(frames, STACK).alias("audio_tokens"), audio.projected_tokens(frames, STACK, True).alias("with_boundaries"), tokens().alias("example_tokens"), audio.dmel_frames(samples(), 512).alias("dmel_frames"))


@query(
    "token_budget",
    """
SELECT turn, n, least(9002, 131072 // n) AS budget, CASE WHEN least(9002, 131072 // n) <= 2 THEN 1 ELSE (2 * ((least(9002, 131072 // n) - 3) * 4 + 1) - 1) * 160 END AS dummy
FROM (SELECT turn, count(*) AS n FROM conversations GROUP BY turn)
""",
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "conversations").groupBy("turn").agg(F.count("*").alias("n"))
    budget = audio.tokens_per_item(F.lit(131072), F.col("n"))
    return counts.select("turn", "n", budget.cast("long").alias("budget"), audio.dummy_samples(budget.cast("long")).alias("dummy"))


_CROP_SQL = bucket_sql(SEED, EPOCH, "doc_id", "greatest(n_chars * 160 - 480000 + 1, 1)")


@query(
    "long_audio_policy",
    f"""
SELECT doc_id, CASE WHEN n_chars * 160 > 480000 THEN (n_chars * 160 - 480000) // 2 END AS center_start, CASE WHEN n_chars * 160 > 480000 THEN {_CROP_SQL} END AS random_start,
  least(n_chars * 160, 480000) AS used_samples, (n_chars * 160 + 479999) // 480000 AS chunk_count, n_chars * 160 > 480000 AS skipped FROM documents
""",
)
def long_audio_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = {p: audio.contract(samples(), p, 30, SEED, EPOCH, F.col("doc_id")) for p in audio.POLICIES}
    rows = table(spark, sf_dir, "documents").select("doc_id", *(v.alias(k) for k, v in made.items()))
    return rows.select("doc_id", F.col("center_crop.crop_start").alias("center_start"), F.col("random_crop.crop_start").alias("random_start"), "center_crop.used_samples", "chunk_pad.chunk_count", "skip.skipped")


@query(
    "sidecar_rounding",
    """
SELECT event_id, CAST(round_even(value * 16000, 0) AS BIGINT) AS samples, greatest(1, CAST(ceil(value / 30 - 1e-12) AS BIGINT)) AS chunks,
  CAST(ceil(CAST(event_id AS DOUBLE) * 16000 / 44100) AS BIGINT) AS resampled FROM events WHERE value IS NOT NULL
""",
)
def sidecar_rounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("value is not null")
    return events.select("event_id", audio.sidecar_samples(F.col("value")).alias("samples"), audio.chunk_count(F.col("value")).alias("chunks"), audio.at_rate(F.col("event_id").cast("double"), F.lit(44100)).alias("resampled"))


@query(
    "length_quantiles_round",
    f"""
WITH {_LENGTHS_SQL}, s AS (SELECT list(len ORDER BY len) AS v, count(*) AS n FROM l)
SELECT share, CAST(v[CAST(round_even((n - 1) * share, 0) AS BIGINT) + 1] AS BIGINT) AS length FROM s, (SELECT unnest([0.5, 0.9, 0.95, 0.99, 1.0])::DOUBLE AS share)
""",
)
def length_quantiles_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_quantiles(lengths(spark, sf_dir), "length", [0.5, 0.9, 0.95, 0.99, 1.0])


@query(
    "duration_quantiles_floor",
    """
WITH s AS (SELECT list(n_chars ORDER BY n_chars) AS v, count(*) AS n FROM documents)
SELECT share, v[CAST(floor(share * (n - 1)) AS BIGINT) + 1] AS n_chars FROM s, (SELECT unnest([0.0, 0.5, 0.9, 0.99, 1.0])::DOUBLE AS share)
""",
)
def duration_quantiles_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_quantiles(table(spark, sf_dir, "documents"), "n_chars", [0.0, 0.5, 0.9, 0.99, 1.0], "floor")


@query(
    "corpus_totals",
    f"SELECT source, count(*) AS n_examples, round(CAST(sum(n_chars) AS DOUBLE) * 160 / 16000 / 3600, 9) AS hours, CAST(sum(len) AS BIGINT) AS tokens, round(avg(len), 9) AS mean_tokens FROM (SELECT *, {TOKENS_SQL} AS len FROM documents) GROUP BY source",
)
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "n_chars", tokens().alias("len"))
    hours = F.sum("n_chars").cast("double") * 160 / 16000 / 3600
    return docs.groupBy("source").agg(F.count("*").alias("n_examples"), F.round(hours, 9).alias("hours"), F.sum("len").cast("long").alias("tokens"), F.round(F.avg("len"), 9).alias("mean_tokens"))


@query("keyed_shuffle_order", f"SELECT doc_id, row_number() OVER (ORDER BY {order_sql(SEED, EPOCH, 'doc_id')}, doc_id) - 1 AS position FROM documents")
def keyed_shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.shuffled(table(spark, sf_dir, "documents").select("doc_id"), SEED, EPOCH, "doc_id")


@query(
    "bounded_shuffle_order",
    f"""
WITH g AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS given FROM documents)
SELECT doc_id, row_number() OVER (ORDER BY given // 100, {order_sql(SEED, 1, 'doc_id')}, given) - 1 AS position FROM g
""",
)
def bounded_shuffle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.block_shuffled(table(spark, sf_dir, "documents").select("doc_id"), SEED, 1, [F.col("doc_id")], 100, "doc_id")


_STRIPES_SQL = f"""
SELECT source, position, CAST(position % 2 AS INTEGER) AS rank, CAST((position // 2) % 3 AS INTEGER) AS worker
FROM (SELECT source, row_number() OVER (ORDER BY {order_sql(SEED, EPOCH, 'source')}, source) - 1 AS position FROM (SELECT DISTINCT source FROM documents))
"""


@query("worker_stripes", _STRIPES_SQL)
def worker_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.stripes(table(spark, sf_dir, "documents"), SEED, EPOCH, "source", 2, 3)


_INTERLEAVED_SQL = f"""
SELECT doc_id, source, row_number() OVER (ORDER BY (2 * own + 1) / (2 * n), {order_sql(SEED, 0, 'source')}, own) - 1 AS position
FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS own, count(*) OVER (PARTITION BY source) AS n FROM documents)
"""


@query("interleave_sources", _INTERLEAVED_SQL)
def interleave_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.interleaved(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", [F.col("doc_id")], SEED)


@query(
    "rank_sync_exhaustion",
    f"""
WITH r AS (SELECT doc_id, {bucket_sql(SEED, 3, "doc_id", "3")} AS rank FROM documents),
s AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY doc_id) - 1 AS step FROM r)
SELECT doc_id, rank, step FROM s WHERE step < (SELECT min(n) FROM (SELECT count(*) AS n FROM r GROUP BY rank))
""",
)
def rank_sync_exhaustion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", audio.stable_bucket(SEED, 3, F.col("doc_id"), 3).alias("rank"))
    return ordering.synchronised(docs, "rank", [F.col("doc_id")])


@query(
    "runtime_worker_sim",
    f"""
WITH RECURSIVE s AS ({_STRIPES_SQL}),
l AS (SELECT d.doc_id, d.source, s.rank * 100 + s.worker AS stream, {TOKENS_SQL} AS len FROM documents d JOIN s USING (source)),
n AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY {order_sql(SEED, EPOCH, 'doc_id')}, doc_id) - 1 AS own FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY (2 * own + 1) / (2 * n), {order_sql(SEED, 0, 'source')}, own) - 1 AS ordinal FROM n),
{_bfd_sql(f"SELECT stream * 1000000 + ordinal // {WINDOW} AS g, CAST({CAPACITY} AS BIGINT) AS cap, CAST(len AS BIGINT) AS len, row_number() OVER (PARTITION BY stream, ordinal // {WINDOW} ORDER BY len DESC, ordinal) AS rn FROM o WHERE len <= {CAPACITY}")}
SELECT CAST(g // 1000000 // 100 AS INTEGER) AS rank, CAST(g // 1000000 % 100 AS INTEGER) AS worker, {_STATS_SQL} FROM bins GROUP BY g // 1000000, cap
""",
)
def runtime_worker_sim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards shuffled and dealt out, samples shuffled in them, sources interleaved, and each worker's stream packed."""
    dealt = ordering.stripes(table(spark, sf_dir, "documents"), SEED, EPOCH, "source", 2, 3)
    rows = lengths(spark, sf_dir).drop("worker").join(dealt.select("source", "rank", "worker"), "source")
    mixed = ordering.interleaved(rows, "source", [order_key(SEED, EPOCH, F.col("doc_id")), F.col("doc_id")], SEED)
    mixed = packing.windows(mixed.withColumn("stream", F.col("rank") * 100 + F.col("worker")), "stream", [F.col("position")], WINDOW)
    stats = packing.pack_stats(packing.packed(mixed, "stream", "length", CAPACITY), ["rank", "worker"], "stream", "length", CAPACITY)
    return stats.select("rank", "worker", "n_packs", "tokens", F.round("utilisation", 9).alias("utilisation"), "lower_bound")


def _fold_sql(items: str, state: str, name: str) -> str:
    return f"""
WITH RECURSIVE items AS ({items}),
step AS (
  SELECT stream, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS number, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS total, CAST(0 AS BIGINT) AS own, CAST(NULL AS BIGINT) AS doc_id FROM (SELECT DISTINCT stream FROM items)
  UNION ALL {state}
)
SELECT doc_id, stream, own AS {name} FROM step WHERE rn > 0
"""


_STREAM_SQL = f"SELECT doc_id, {_WORKER_SQL} AS stream, CAST(n_chars AS BIGINT) AS w, row_number() OVER (PARTITION BY {_WORKER_SQL} ORDER BY doc_id) AS rn FROM documents"


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", audio.stable_bucket(SEED, EPOCH, F.col("doc_id"), WORKERS).alias("stream"), F.col("n_chars").cast("long").alias("w"))


@query(
    "greedy_request_chunks",
    _fold_sql(
        _STREAM_SQL,
        """SELECT s.stream, i.rn, CASE WHEN s.n > 0 AND (s.n >= 8 OR s.total + i.w > 5000) THEN s.number + 1 ELSE s.number END,
    CASE WHEN s.n > 0 AND (s.n >= 8 OR s.total + i.w > 5000) THEN 1 ELSE s.n + 1 END, CASE WHEN s.n > 0 AND (s.n >= 8 OR s.total + i.w > 5000) THEN i.w ELSE s.total + i.w END,
    CASE WHEN s.n > 0 AND (s.n >= 8 OR s.total + i.w > 5000) THEN s.number + 1 ELSE s.number END, i.doc_id
  FROM step s JOIN items i ON i.stream = s.stream AND i.rn = s.rn + 1""",
        "chunk",
    ),
)
def greedy_request_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.request_chunks(_streams(spark, sf_dir), "stream", ["doc_id"], "w", 8, 5000).select("doc_id", "stream", "chunk")


@query(
    "grad_accum_groups",
    _fold_sql(
        _STREAM_SQL,
        """SELECT s.stream, i.rn, CASE WHEN s.total + i.w >= 6000 OR s.n + 1 >= 5 THEN s.number + 1 ELSE s.number END,
    CASE WHEN s.total + i.w >= 6000 OR s.n + 1 >= 5 THEN 0 ELSE s.n + 1 END, CASE WHEN s.total + i.w >= 6000 OR s.n + 1 >= 5 THEN 0 ELSE s.total + i.w END, s.number, i.doc_id
  FROM step s JOIN items i ON i.stream = s.stream AND i.rn = s.rn + 1""",
        '"group"',
    ),
)
def grad_accum_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.accumulation_groups(_streams(spark, sf_dir), "stream", ["doc_id"], "w", 6000, 5).select("doc_id", "stream", "group")


_TURN_SQL = "WITH t AS (SELECT conv_id, turn, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) % 7 AS b, CAST(turn AS INTEGER) % 3 AS a, CAST(length(text) AS INTEGER) % 5 + 1 AS g FROM conversations)"


@query(
    "packed_layout_tokens",
    f"""
{_TURN_SQL}, s AS (SELECT *, b + (a + 2) + 1 + g AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM t),
p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
x AS (SELECT *, unnest(range(n)) AS pos FROM p),
y AS (
  SELECT conv_id, CAST(seq AS INTEGER) AS seq, CAST(start + pos AS BIGINT) AS place, CAST(pos AS INTEGER) AS pos,
    CAST(CASE WHEN pos < b THEN 1 + pos WHEN pos < b + a + 2 THEN 0 WHEN pos = b + a + 2 THEN 7 ELSE 100 + pos - (b + a + 3) END AS INTEGER) AS id,
    CAST(CASE WHEN pos >= n - g THEN 100 + pos - (b + a + 3) ELSE -100 END AS INTEGER) AS label,
    pos >= b AND pos < b + a + 2 AS audio_slot, pos > b AND pos < b + a + 1 AS audio_frame FROM x)
SELECT *, coalesce(lead(label) OVER (PARTITION BY conv_id ORDER BY place) <> -100, false) AS supervised FROM y
""",
)
def packed_layout_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    n_before, n_target = F.pmod(words(F.col("text")), F.lit(7)).cast("int"), (F.pmod(F.length("text"), F.lit(5)) + 1).cast("int")
    none = F.array().cast("array<int>")
    before = F.when(n_before > 0, F.sequence(F.lit(1), n_before)).otherwise(none)
    rows = turns.select("conv_id", "turn", before.alias("before"), F.pmod("turn", F.lit(3)).alias("audio"), F.array(F.lit(7)).alias("after"), F.sequence(F.lit(100), n_target + 99).alias("target"))
    return packing.layout(rows, ["conv_id"], [F.col("turn")]).drop("turn")


@query(
    "committed_pack_filter",
    f"""
WITH w AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 10 AS pack FROM documents)
SELECT doc_id, pack FROM w WHERE pack % 3 <> 0
""",
)
def committed_pack_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ordering.with_position(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")])
    packs = placed.select("doc_id", F.floor(F.col("position") / 10).cast("long").alias("pack"))
    return packing.uncommitted(packs, ["pack"], "doc_id", packs.filter("pack % 3 = 0").select("doc_id"))


@query(
    "keep_last_n",
    """
SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS late, max(o_totalprice) OVER (PARTITION BY o_custkey) AS best FROM orders)
WHERE late <= 3 OR o_totalprice = best
""",
)
def keep_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    best = orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"))
    marked = orders.join(best, "o_custkey")
    kept = ordering.last_kept(marked, "o_custkey", [F.col("o_orderkey")], 3, F.col("o_totalprice") == F.col("best"))
    return kept.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


@query(
    "running_best_metric",
    "SELECT event_id, value, min(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM events",
)
def running_best_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.running_min(table(spark, sf_dir, "events").select("event_id", "value"), [F.col("event_id")], "value")

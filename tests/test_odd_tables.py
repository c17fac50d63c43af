"""Queries against their SQL on small tables with what larger ones hold."""

import base64

import duckdb
from pyspark.sql import functions as F

from lodestream.functions import audio
from lodestream.operators import packing
from lodestream.plans import QUERIES, SQL
from lodestream.plans.files import _header
from lodestream.sources import sinks


def agree(spark, folder, name, **tables):
    """The query's rows over tables of given SQL, after they have been held against those of its own SQL."""
    con = duckdb.connect()
    for table, rows in tables.items():
        con.execute(f"copy ({rows}) to '{folder}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    assert found == sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=repr)
    return [dict(zip(columns, r, strict=True)) for r in found]


def test_requests_beyond_the_capacity_have_waves_of_their_own(spark, tmp_path):
    values = "case k % 11 when 3 then 601.5 when 5 then -700 when 7 then 'nan'::double when 8 then 'inf'::double when 9 then null else k end"
    rows = agree(spark, tmp_path, "in_flight_waves", events=f"select k as event_id, k % 6 as user_id, {values} as value from range(120) t(k)")
    waves = {(r["stream"], r["wave"]): [] for r in rows}
    for r in rows:
        waves[r["stream"], r["wave"]].append(r["event_id"])
    assert len(rows) == 120 and all(len(x) == 1 for x in waves.values() if any(k % 11 in (3, 5, 7, 8) for k in x))


def test_updates_of_a_stream_that_is_cut_into_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "BLOCKS_FROM", 0)
    monkeypatch.setattr(packing, "BLOCK_ROWS", 32)
    rows = agree(spark, tmp_path, "epoch_updates", events="select k as event_id, 0 as user_id from range(1000) t(k)")
    assert len(rows) == 400 and max(r["epoch"] for r in rows) == 2


def test_long_uris_are_one_line(spark, tmp_path):
    rows = agree(spark, tmp_path, "data_uris", pages="select k as page_id, case when k % 50 = 7 then null else repeat('ü/', k // 2) || 'x' end as url from range(130) t(k)")
    assert len(rows) == 130
    wave = spark.range(1).select(F.array(F.array_repeat(F.lit(0.5), 200)).alias("channels"))
    uri = sinks.wav_uri(wave, "channels", 16000).first()["uri"]
    assert uri.split() == [uri] and len(base64.b64decode(uri.split(",")[1], validate=True)) == 444


def test_counts_that_a_header_cannot_hold(spark, tmp_path):
    sizes = "[0, 1, 68718, 68719, 68720, 128657, 1100000, 4398046511][1 + k % 8]"
    rows = agree(spark, tmp_path, "flac_headers", documents=f"select k as doc_id, {sizes} as n_chars from range(90) t(k)")
    assert len(rows) == 90 and max(r["samples"] or 0 for r in rows) > 1 << 36
    counts = spark.createDataFrame([(5,), (68719476735,), (68719476736,), (-1,), (None,)], "n long")
    found = counts.select(audio.streaminfo(_header(F.lit(48000), F.lit(8), F.col("n"))).alias("i")).select("i.*").collect()
    assert [tuple(r) for r in found] == [(48000, 8, n) for n in (5, 68719476735, 0, 0, 0)]

"""Every registered query against its SQL at the smallest size."""

import os

import duckdb
import pytest

from lodestream.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_what_its_sql_gives(spark, db, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    assert found
    cursor = db.execute(SQL[name])
    names, kinds = [d[0] for d in cursor.description], [str(d[1]) for d in cursor.description]
    assert sorted(names) == columns
    assert found == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in cursor.fetchall())
    for c, kind in df.dtypes:
        assert KINDS.get(kind, kind) == kinds[names.index(c)], c


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(SQL) <= set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns

"""The registered queries: a name, a function of (spark, sf_dir) and, where SQL can say the same, DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import WHITE_SPACE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def bucket_sql(seed: int, epoch: int, key: str, n: str) -> str:
    """functions.hashing.stable_bucket in SQL."""
    return f"CAST(CAST('0x' || substr(sha256('{seed}' || chr(0) || '{epoch}' || chr(0) || CAST({key} AS VARCHAR)), 1, 16) AS UBIGINT) % CAST(({n}) AS UBIGINT) AS BIGINT)"


def order_sql(seed: int, epoch: int, key: str) -> str:
    """functions.hashing.order_key in SQL."""
    return f"sha256('{seed}' || chr(0) || '{epoch}' || chr(0) || CAST({key} AS VARCHAR))"


def strip_sql(value: str) -> str:
    """functions.text.stripped in SQL."""
    return f"trim({value}, {' || '.join(f'chr({ord(c)})' for c in WHITE_SPACE)})"

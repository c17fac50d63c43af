"""Hashes as Catalyst expressions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUL = "\0"


def sha256(value: Column) -> Column:
    """Hex digest of text or bytes."""
    return F.sha2(value.cast("binary"), 256)


def _text(value: Column | int | str) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def leading_uint64(digest: Column) -> Column:
    """The first 16 hex digits as an unsigned number; decimal(20,0) takes all of them."""
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def stable_bucket(seed: Column | int, epoch: Column | int, key: Column, n: Column | int) -> Column:
    """The number from 0 to n - 1 that seed, epoch and key choose, the same in any language with SHA-256. n must be positive."""
    n = n if isinstance(n, Column) else F.lit(n)
    checked = F.when(n > 0, n).otherwise(F.raise_error(F.lit("the number of buckets must be positive")).cast("long"))
    digest = sha256(F.concat_ws(NUL, _text(seed), _text(epoch), _text(key)))
    return F.pmod(leading_uint64(digest), checked.cast("decimal(20,0)")).cast("long")


def order_key(seed: int, epoch: int, *keys: Column) -> Column:
    """A key whose order is a shuffle that seed and epoch fix."""
    return sha256(F.concat_ws(NUL, _text(seed), _text(epoch), *map(_text, keys)))


def is_revision(value: Column, any_case: bool = False) -> Column:
    """Whether value is a full 40-digit revision."""
    return F.coalesce((F.lower(value) if any_case else value).rlike("^[0-9a-f]{40}$"), F.lit(False))


def media_id(audio_id: Column, digest: Column, crop_start: Column, samples: Column, frontend: Column, projector: Column) -> Column:
    """One identity for a piece of audio under given processing; a missing crop is written None."""
    crop = F.coalesce(crop_start.cast("string"), F.lit("None"))
    return sha256(F.concat_ws(NUL, audio_id, digest, crop, samples.cast("string"), frontend, projector))


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, ASCII only; what isn't JSON by its text."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def canonical_hash(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def canonical_json_hash(text: Column) -> Column:
    """canonical_hash of JSON text; to_json can't do it, as it leaves letters beyond ASCII as they are."""

    @F.pandas_udf("string")
    def digest(values: pd.Series) -> pd.Series:
        return values.map(lambda x: None if x is None else canonical_hash(json.loads(x)))

    return digest(text)


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """fingerprint (one digest of the table, whatever the order of its rows) and n_rows."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in columns]
    rows = df.select(sha256(F.concat_ws(NUL, *parts)).alias("h"))
    # Sums of digests are the same in any order and add up before the shuffle; equal rows count each time.
    words = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"w{k}") for k in range(4)]
    total = rows.agg(F.count("*").alias("n"), *words)
    return total.select(sha256(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n", "w0", "w1", "w2", "w3")))).alias("fingerprint"), F.col("n").alias("n_rows"))

"""Following a folder of validation results: what is new since the last look, and the best so far."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import running_min
from .commits import commit_once

RESULT = "update long, nll double"


def follow(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """update, nll and best (the least nll so far) of the JSON results in a folder; each look reads only what is new."""
    stream = spark.readStream.schema(RESULT).option("multiLine", "true").json(folder)
    rows = commit_once(stream.filter(F.col("update").isNotNull()), "update", epoch=0, path=state, duplicates="drop")
    return running_min(rows.drop("epoch"), [F.col("update")], "nll")

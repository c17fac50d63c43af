"""A packing planner over a stream: each worker's buffer of bounded size is its state.

It packs as operators/packing.py does: a window is so many consecutive rows, oversized ones among them, and the last one may be
shorter. A stream doesn't say when it ends, so an end mark does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.packing import best_fit

_STATE = "ordinals array<long>, lengths array<long>, taken long, seen long, skipped long"
_OUT = "worker long, window long, pack int, ordinal long, length long, skipped long"


def planned(stream: DataFrame, capacity: int, window: int) -> DataFrame:
    """Packs of a stream (worker, ordinal, length): a worker's window closes once it has taken so many rows, or at an end mark.

    skipped counts the worker's oversized rows so far. Rows that don't fill a window wait in the state for more or for the end.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ordinals, lengths, taken, seen, skipped = state.get if state.exists else ([], [], 0, 0, 0)
        ordinals, lengths = list(ordinals), list(lengths)
        arrived = pd.concat(list(frames)).sort_values("ordinal", na_position="last")
        for ordinal, length, ends in zip(arrived["ordinal"].tolist(), arrived["length"].tolist(), arrived["length"].isna().tolist(), strict=True):
            if not ends:
                taken += 1
                if length > capacity:
                    skipped += 1
                else:
                    ordinals.append(int(ordinal))
                    lengths.append(int(length))
            if taken == window or ends and taken:
                if lengths:
                    yield pd.DataFrame({"worker": key[0], "window": seen, "pack": best_fit(lengths, capacity), "ordinal": ordinals, "length": lengths, "skipped": skipped})
                ordinals, lengths, taken, seen = [], [], 0, seen + 1
        state.update((ordinals, lengths, taken, seen, skipped))

    return stream.groupBy("worker").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def end_marks(workers: DataFrame) -> DataFrame:
    """The rows that end the streams of workers (worker): they come after all others, in the same batch or a later one."""
    none = F.lit(None).cast("long")
    return workers.select(F.col("worker").cast("long").alias("worker"), none.alias("ordinal"), none.alias("length")).distinct()

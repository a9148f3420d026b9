"""Run history as a stream: totals in event-time windows, and a high-water mark with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, at: str, key: str, value: str, width: str, late: str) -> DataFrame:
    """(key, start, n, total) of tumbling windows; events later than ``late`` behind the newest are dropped."""
    held = events.withWatermark(at, late).groupBy(F.window(at, width), key)
    return held.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(key, F.col("window.start").alias("start"), "n", "total")


def high_water(events: DataFrame, key: str, at: str, delta: str, key_type: str = "long") -> DataFrame:
    """(key, total, high_water) after every batch: the running sum of ``delta`` and its maximum, at least 0."""

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, top = state.get if state.exists else (0, 0)
        rows = pd.concat(list(frames)).sort_values(at)
        sums = total + rows[delta].cumsum()
        total, top = int(sums.iloc[-1]), max(int(top), int(sums.max()), 0)
        state.update((total, top))
        yield pd.DataFrame({key: [group[0]], "total": [total], "high_water": [top]})

    return events.select(key, at, F.col(delta).cast("long").alias(delta)).groupBy(key).applyInPandasWithState(step, f"{key} {key_type}, total long, high_water long", "total long, high_water long", "update", GroupStateTimeout.NoTimeout)

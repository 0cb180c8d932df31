"""Structured Streaming over a growing vertex log: running lengths per fiber, and windowed counts with late rows dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

STATE = "x double, y double, z double, length double, vertices long"
OUT = "fiber_id long, vertices long, length double"


def windowed_counts(stream: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "6 hours") -> DataFrame:
    """(window, event_type, n, total): rows later than ``late`` behind the newest are dropped with their window's state."""
    return (
        stream.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    )


def running_lengths(stream: DataFrame) -> DataFrame:
    """(fiber_id, vertices, length) after every batch, for rows (fiber_id, seq, x, y, z) that arrive in order per fiber.

    The state of a fiber is its last vertex and two sums.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        x, y, z, length, n = state.get if state.exists else (None, None, None, 0.0, 0)
        for f in frames:
            for p in f.sort_values("seq")[["x", "y", "z"]].itertuples(index=False):
                if n:
                    length += ((p.x - x) ** 2 + (p.y - y) ** 2 + (p.z - z) ** 2) ** 0.5
                x, y, z, n = p.x, p.y, p.z, n + 1
        state.update((x, y, z, length, n))
        yield pd.DataFrame({"fiber_id": [key[0]], "vertices": [n], "length": [length]})

    return stream.groupBy("fiber_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)

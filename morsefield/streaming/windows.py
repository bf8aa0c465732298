"""Streams of events: time windows with watermarks, and count-based sliding windows with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 day", slide: str | None = None) -> DataFrame:
    """(start, end, event_type, n, total): event-time windows; rows later than the watermark are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def count_windows(events: DataFrame, size: int, stride: int = 1) -> DataFrame:
    """(user_id, k, values): the last ``size`` values of a user at every ``stride``-th event once there are so many.

    State is the last size values and a counter, so it is bounded per user. Rows of a batch are taken in order of time; a
    row that comes in a later batch than its successors counts when it comes.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        values, n = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for v in rows["value"]:
            values = [*values, float(v)][-size:]
            n += 1
            if n >= size and (n - size) % stride == 0:
                out.append((key[0], n, list(values)))
        state.update((values, n))
        yield pd.DataFrame(out, columns=["user_id", "k", "values"])

    own = events.select("user_id", "ts", "event_id", "value")
    return own.groupBy("user_id").applyInPandasWithState(step, "user_id long, k long, values array<double>", "values array<double>, n long", "append", GroupStateTimeout.NoTimeout)

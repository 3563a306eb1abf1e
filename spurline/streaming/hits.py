"""The field-record queries on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows for each window and key; events later than `late` behind the newest are dropped, and so is their state."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", key, "n")


def independent_stream(events: DataFrame, key: str, ts: str, minutes: int = 30, late: str = "2 hours") -> DataFrame:
    """Independent detections as they come in: key, ts and whether the time counts.

    The state of a key is the newest time it has seen; it is dropped once the watermark is over `minutes` past it, as any
    later time counts anyway. Times in a batch are taken in order; a time older than the newest seen counts only if no seen time is near.
    """
    gap = pd.Timedelta(minutes=minutes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        times = pd.concat(list(frames))[ts].sort_values()
        counts = []
        for t in times:
            counts.append(newest is None or abs(t - newest) >= gap)
            newest = t if newest is None else max(newest, t)
        state.update((int(newest.value // 1000),))
        if state.getCurrentWatermarkMs() < newest.value // 1_000_000 + minutes * 60_000:
            state.setTimeoutTimestamp(int(newest.value // 1_000_000) + minutes * 60_000)
        yield pd.DataFrame({key: k[0], ts: times, "counts": counts})

    kind = dict(events.dtypes)[key]
    return events.withWatermark(ts, late).select(key, ts).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {ts} timestamp, counts boolean", "newest long", "append", GroupStateTimeout.EventTimeTimeout)

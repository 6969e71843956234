"""The metric history as a stream: the same sampling rule with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sift.config import HISTORY, HistoryPolicy
from sift.operators.history import keep_from


def sample_stream(readings: DataFrame, policy: HistoryPolicy = HISTORY) -> DataFrame:
    """Streaming twin of sample_history without the per-source cap, which is applied when the history is read.

    readings: a stream (source, at BIGINT ms, reading BIGINT); append mode. Rows of a source must not arrive in a later
    micro-batch than newer ones of it: a reading before the last kept one is left out, as is one older than the newest
    of all sources by more than the retention limit. A source's state is its last kept time; it is dropped once the
    watermark has passed it by that limit."""
    timed = readings.where(F.col("source").isNotNull() & F.col("at").isNotNull()).select(
        "source", "at", "reading", F.timestamp_millis("at").alias("_event"),
    ).withWatermark("_event", f"{policy.max_age_ms} milliseconds")

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["at", "reading"]).drop_duplicates("at")
        last = state.get[0] if state.exists else None
        kept = keep_from(rows["at"].to_numpy(), last, policy.min_interval_ms)
        if len(kept):
            last = int(kept[-1])
            state.update((last,))
            yield rows[rows["at"].isin(kept)][["source", "at", "reading"]]
        if last is not None:
            state.setTimeoutTimestamp(max(last + policy.max_age_ms, state.getCurrentWatermarkMs() + 1))

    return timed.groupBy("source").applyInPandasWithState(step, "source string, at long, reading long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def dedupe_stream(items: DataFrame, key: str, event_time: str, delay: str) -> DataFrame:
    """Extension: the first arrival of each key within the watermark's delay."""
    return items.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])

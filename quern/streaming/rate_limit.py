"""Token buckets: a key starts full, gains tokens by time up to its capacity, and an event needs a whole one.

In batch, events are dealt by key and sorted within partitions, and a task folds
them in a stream with one bucket in hand, so no key's events are gathered. In a
stream, the bucket is the key's state, and it expires when it has been idle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CAPACITY, PER_SECOND = 30.0, 1.0
IDLE_MS = 3_600_000
OUT = "key string, event_id long, seconds double, tokens double, allowed boolean"


def step(tokens: float, last: float, now: float, capacity: float, rate: float) -> tuple[float, bool]:
    tokens = min(capacity, tokens + (now - last) * rate)
    return (tokens - 1, True) if tokens >= 1 else (tokens, False)


def limited(events: DataFrame, capacity: float = CAPACITY, rate: float = PER_SECOND) -> DataFrame:
    """key, event_id, seconds, tokens left, allowed. ``events``: key string, event_id long, seconds double."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, tokens, last = None, 0.0, 0.0
        for b in batches:
            left, allowed = [], []
            for k, now in zip(b["key"], b["seconds"]):
                if k != key:
                    key, tokens, last = k, capacity, now
                tokens, ok = step(tokens, last, now, capacity, rate)
                last = now
                left.append(tokens)
                allowed.append(ok)
            yield b.assign(tokens=left, allowed=allowed)

    ordered = events.select("key", "event_id", "seconds").where("key IS NOT NULL").repartition("key").sortWithinPartitions("key", "seconds", "event_id")
    return ordered.mapInPandas(run, OUT)


def limited_stream(events: DataFrame, capacity: float = CAPACITY, rate: float = PER_SECOND) -> DataFrame:
    """The same for a streaming DataFrame; within a micro-batch events are taken in order of time."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        for b in parts:
            b = b.sort_values(["seconds", "event_id"])
            tokens, last = state.get if state.exists else (capacity, float(b["seconds"].iloc[0]))
            left, allowed = [], []
            for now in b["seconds"]:
                tokens, ok = step(tokens, last, now, capacity, rate)
                last = now
                left.append(tokens)
                allowed.append(ok)
            state.update((float(tokens), float(last)))
            state.setTimeoutDuration(IDLE_MS)
            yield b.assign(tokens=left, allowed=allowed)[["key", "event_id", "seconds", "tokens", "allowed"]]

    return events.groupBy("key").applyInPandasWithState(run, OUT, "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)

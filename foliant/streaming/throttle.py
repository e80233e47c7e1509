"""Stateful stream operators: two throttles, dead letters, deduplication of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def fixed_from_first_hit(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """user_id, allowed, refused: a counter whose window opens at the first hit and isn't aligned to the clock. A row for each key and batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, used = state.get if state.exists else (None, 0)
        allowed = refused = 0
        for at in sorted(t for f in frames for t in f["at"]):
            if opened is None or at >= opened + seconds:
                opened, used = at, 0
            used += 1
            allowed, refused = allowed + (used <= limit), refused + (used > limit)
        state.update((opened, used))
        yield pd.DataFrame({"user_id": [key[0]], "allowed": [allowed], "refused": [refused]})

    rows = events.select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, allowed long, refused long", "opened long, used int", "append", GroupStateTimeout.NoTimeout)


def sliding(events: DataFrame, limit: int, seconds: int) -> DataFrame:
    """Like it, with a trailing window in which refused hits aren't counted."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        allowed = refused = 0
        for at in sorted(t for f in frames for t in f["at"]):
            held = [x for x in held if x > at - seconds]
            if len(held) < limit:
                held.append(at)
                allowed += 1
            else:
                refused += 1
        state.update((held,))
        yield pd.DataFrame({"user_id": [key[0]], "allowed": [allowed], "refused": [refused]})

    rows = events.select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, allowed long, refused long", "held array<long>", "append", GroupStateTimeout.NoTimeout)


def once_per_token(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Redelivered tokens are dropped while the watermark holds their state."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def dead_letters(events: DataFrame, limit: int) -> DataFrame:
    """user_id, event_id, ts: of each token the delivery that is one over the limit. The count is state, so it may come in any batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["at", "event_id"])
        if seen <= limit < seen + len(rows):
            dead = rows.iloc[[limit - seen]]
            yield pd.DataFrame({"user_id": [key[0]], "event_id": dead["event_id"].tolist(), "at": dead["at"].tolist()})
        state.update((seen + len(rows),))

    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    found = rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, at long", "seen long", "append", GroupStateTimeout.NoTimeout)
    return found.select("user_id", "event_id", F.timestamp_micros("at").cast("timestamp_ntz").alias("ts"))

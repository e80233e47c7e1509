"""Stream operators with state for each key and timers in event time: notices once, guards against handing in again, quotas by local day.

State lies in the state store (RocksDB), so what is known of a key outlives the run, and only what a key needs is read. A key's rows of one micro-batch are sorted in memory where order counts: the source's ``maxFilesPerTrigger`` bounds them. Timers fire when the watermark passes them, which lets go of what is no longer needed.
Rows without a key or a time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_with_timers(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state in the store that timers need; the session's setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def _timed(rows: DataFrame, keys: list[str], delay: str) -> DataFrame:
    return rows.filter(F.col("at").isNotNull() & F.concat_ws("", *keys).isNotNull()).na.drop(subset=keys).withColumn("ms", F.unix_millis("at")).withWatermark("at", delay)


NO_TIMER = -(1 << 62)


class _CompletedOnce(StatefulProcessor):
    def __init__(self, patience_ms: int, keep_ms: int) -> None:
        self.patience_ms, self.keep_ms = patience_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        # every call asks the executor's JVM, so a batch is one value, and its runs are read and written once each
        self.handle = handle
        self.runs = handle.getMapState("runs", "run_id long", "ended boolean")
        self.batch = handle.getValueState("batch", "complete boolean, overdue boolean, seen long, open long, expected long, last long, timer long")

    def _remind(self, timer: int, at: int) -> int:
        if timer != at:
            if timer != NO_TIMER:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(at)
        return at

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = self.batch.get()
        complete, overdue, seen, open_, expected, last, timer = known or (False, False, 0, 0, 0, 0, NO_TIMER)
        if complete:  # redelivered after the notice: nothing more to say
            return
        heard: dict[int, bool] = {}
        for r in rows:
            expected, last = max(expected, r.expected or 0), max(last, r.ms)
            if r.run_id is not None:
                heard[r.run_id] = heard.get(r.run_id, False) or bool(r.ended)
        changed = []
        for run, ended in heard.items():
            before = self.runs.getValue((run,)) if known and self.runs.containsKey((run,)) else None
            if before is None or ended and not before[0]:
                seen += before is None
                open_ += (1 if before is None else 0) - (1 if ended else 0)
                changed.append((run, ended))
        if expected and seen >= expected and open_ == 0:
            if known:
                self.runs.clear()
            self.batch.update((True, overdue, 0, 0, 0, 0, self._remind(timer, last + self.keep_ms)))
            yield Row(batch_id=key[0], notice="complete", runs=seen, open=0)
        else:
            for run, ended in changed:
                self.runs.updateValue((run,), (ended,))
            timer = timer if overdue else self._remind(timer, last + self.patience_ms)
            self.batch.update((False, overdue, seen, open_, expected, last, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        complete, _, seen, open_, expected, last, _ = self.batch.get()
        if complete:
            self.batch.clear()
            return
        self.batch.update((False, True, seen, open_, expected, last, NO_TIMER))
        yield Row(batch_id=key[0], notice="overdue", runs=seen, open=open_)

    def close(self) -> None:
        pass


def completed_once(statuses: DataFrame, patience_seconds: int, keep_seconds: int, delay: str = "1 hour") -> DataFrame:
    """batch_id, notice, runs, open from batch_id, run_id, ended, expected, at.

    One ``complete`` notice a batch, when as many runs as expected have been seen and all have ended, whatever the order, the number of deliveries or restarts between them; an ended run stays ended. One ``overdue`` notice at most, when a batch hasn't been heard of for so long; it can still become complete.
    The mark of a notice is kept for ``keep_seconds`` after the last status, so later redelivery is quiet as long as it comes within them. A batch with nothing expected is never complete."""
    rows = _timed(statuses.select("batch_id", "run_id", "ended", F.col("expected").cast("long").alias("expected"), "at"), ["batch_id"], delay)
    return rows.groupBy("batch_id").transformWithState(_CompletedOnce(patience_seconds * 1000, keep_seconds * 1000), "batch_id long, notice string, runs long, open long", "append", "eventTime")


class _OncePerSpell(StatefulProcessor):
    def __init__(self, ms: int) -> None:
        self.ms = ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        last = before = self.last.get()[0] if self.last.exists() else None
        for ms, token in sorted((r.ms, r.token) for r in rows):
            if last is None or ms >= last + self.ms:
                last = ms
                yield Row(run_id=key[0], token=token, ms=ms)
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.ms)
            self.last.update((last,))
            self.handle.registerTimer(last + self.ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def once_per_spell(tokens: DataFrame, seconds: int, delay: str = "1 hour") -> DataFrame:
    """run_id, token, ms: the tokens (run_id, token, at) that may pass. One that passes shuts the door on its run for so many seconds; one that is refused doesn't prolong that. A run's state goes when the watermark passes the spell's end. Of two at one millisecond the smaller token passes."""
    rows = _timed(tokens.select("run_id", "token", "at"), ["run_id", "token"], delay)
    return rows.groupBy("run_id").transformWithState(_OncePerSpell(seconds * 1000), "run_id long, token long, ms long", "append", "eventTime")


class _FirstOfDay(StatefulProcessor):
    def __init__(self, limit: int) -> None:
        self.limit = limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh = not self.used.exists()
        n, ends = 0 if fresh else self.used.get()[0], 0
        for ms, token, end in sorted((r.ms, r.token, r.ends) for r in rows):
            n, ends = n + 1, end
            yield Row(user_id=key[0], token=token, allowed=n <= self.limit)
        self.used.update((n,))
        if fresh:
            self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.used.clear()
        return iter(())

    def close(self) -> None:
        pass


def daily_quota(hits: DataFrame, limit: int, zone: str, delay: str = "1 hour") -> DataFrame:
    """user_id, token, allowed: the first hits (user_id, token, at) of a user's day are allowed. Days run from midnight to midnight in the zone, so some have 23 or 25 hours; a day's counter goes when the watermark passes the next midnight."""
    at = _timed(hits.select("user_id", "token", "at"), ["user_id", "token"], delay)
    day = F.to_date(F.from_utc_timestamp("at", zone))
    ends = F.unix_millis(F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), zone))
    rows = at.withColumn("day", day).withColumn("ends", ends)
    return rows.groupBy("user_id", "day").transformWithState(_FirstOfDay(limit), "user_id long, token long, allowed boolean", "append", "eventTime")

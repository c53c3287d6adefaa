"""Rolling quota and login lock-out, in batch and as streams.

A user's state changes at most once a second: all events of a second are
summed up first, natively, and one transition takes the state over the second.
In batch a user's seconds are cut where a silence makes the state irrelevant
and transitions run over Arrow batches of them with constant memory; the
events of a second are then decided by joining its result back. The streams
keep the same state per user in Spark's state store, with timers that drop it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW_SECONDS = 3600
CHAT_LIMIT = 20
BUILD_LIMIT = 5
LOCK_SECONDS = 900
LOCK_FAILURES = 5


def _segments(seconds: DataFrame, user: str, ts: str, silence: int, inclusive: bool) -> DataFrame:
    """Add ``_segment``: rows of a user with no silence of ``silence`` seconds between them.

    Rows in one clock slot of that length are never apart that far, so the
    cuts are found on one row per (user, slot).
    """
    slotted = seconds.withColumn("_slot", F.floor(F.col(ts) / silence))
    slots = slotted.groupBy(user, "_slot").agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    w = Window.partitionBy(user).orderBy("_slot")
    gap = F.col("_first") - F.lag("_last").over(w)
    cut = (gap > silence) if inclusive else (gap >= silence)
    slots = slots.withColumn("_cut", F.when(cut, 1).otherwise(0))
    slots = slots.select(user, "_slot", F.sum("_cut").over(w).alias("_segment"))
    return slotted.join(slots, [user, "_slot"]).drop("_slot")


def _transitions(seconds: DataFrame, user: str, cols: list[str], start: Callable, step: Callable, out: str) -> DataFrame:
    """``step(state, ts, *cols) -> (result, state)`` over the seconds of each segment in order; ``user, ts, out``."""
    kind = dict(seconds.dtypes)[user]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            results = []
            users = batch.column(0)
            for owner, segment, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (owner, segment) != current:
                    current, state = (owner, segment), start()
                result, state = step(state, *row)
                results.append(result)
            yield pa.RecordBatch.from_arrays([users, batch.column(2), pa.array(results, pa.int64())], names=[user, "ts", out])

    rows = seconds.select(user, "_segment", "ts", *cols).repartition(user, "_segment").sortWithinPartitions(user, "_segment", "ts")
    return rows.mapInArrow(run, f"`{user}` {kind}, ts long, `{out}` long")


def admit(times: list[tuple[int, int]], now: int, events: int, limit: int) -> tuple[int, list[tuple[int, int]]]:
    """How many of a second's events are admitted; the state holds (second, admitted) of the last hour, its ends included."""
    times = [t for t in times if t[0] >= now - WINDOW_SECONDS]
    free = min(events, limit - sum(n for _, n in times))
    return (free, [*times, (now, free)]) if free > 0 else (0, times)


def quota(events: DataFrame, limit: int = CHAT_LIMIT) -> DataFrame:
    """``admitted`` for every ``events(user_id, ts, event_id)``; ``ts`` in whole seconds.

    The first events of a second, by id, are admitted, as many as the hour has
    room for; only admitted events take room.
    """
    limit = max(1, limit)
    rows = events.select("user_id", F.col("ts").cast("long").alias("ts"), "event_id")
    seconds = rows.groupBy("user_id", "ts").agg(F.least(F.count("*"), F.lit(limit)).alias("n"))
    cut = _segments(seconds, "user_id", "ts", WINDOW_SECONDS, True)
    free = _transitions(cut, "user_id", ["n"], list, lambda s, now, n: admit(s, now, n, limit), "free")
    rank = F.row_number().over(Window.partitionBy("user_id", "ts").orderBy("event_id"))
    return rows.withColumn("_rank", rank).join(free, ["user_id", "ts"]).select("user_id", "ts", "event_id", (F.col("_rank") <= F.col("free")).alias("admitted"))


def failures_before(state: tuple[int, int], now: int) -> int:
    """Failures that still count; ``LOCK_FAILURES`` or more mean locked."""
    failures, start = state
    return failures if failures and now - start < LOCK_SECONDS else 0


def pass_second(state: tuple[int, int], now: int, lead: int, run: int, tail: int | None) -> tuple[int, tuple[int, int]]:
    """Failures that count at the beginning of a second, and the state (failures, start) after it.

    ``lead`` failures come before the second's first success, ``tail`` after
    its last one (None without any), and ``run`` is the longest row of failures
    after a success. Once locked, nothing changes the state.
    """
    before = failures_before(state, now)
    if before >= LOCK_FAILURES:
        return before, state
    start = state[1] if before else now
    if tail is None or before + lead >= LOCK_FAILURES:
        count = min(before + lead, LOCK_FAILURES)
        return before, (count, start if count else 0)
    if run >= LOCK_FAILURES:
        return before, (LOCK_FAILURES, now)
    return before, (tail, now if tail else 0)


def lockout(events: DataFrame) -> DataFrame:
    """``locked`` for every ``events(username, ts, event_id, ok)``.

    Events of a second are numbered by stretches between its successes, so one
    row per second tells all that the next second needs.
    """
    own = ["username", "ts"]
    rows = events.select("username", F.col("ts").cast("long").alias("ts"), "event_id", F.coalesce("ok", F.lit(False)).alias("ok"))
    before = Window.partitionBy(*own).orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    failed = (~F.col("ok")).cast("long")
    rows = rows.withColumn("_stretch", F.coalesce(F.sum(F.col("ok").cast("long")).over(before), F.lit(0)))
    inside = Window.partitionBy(*own, "_stretch").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.sum(failed).over(inside))
    lead, later = F.col("_stretch") == 0, F.col("_stretch") > 0
    rows = rows.select(
        *own, "event_id", "ok", "_stretch", "_run",
        F.coalesce(F.sum(F.when(lead, failed)).over(before), F.lit(0)).alias("_lead"),
        F.coalesce(F.max(F.when(later, F.col("_run"))).over(before), F.lit(0)).alias("_longest"),
    )
    stretches = rows.groupBy(*own, "_stretch").agg(F.sum(failed).alias("failures"), F.max("ok").alias("ended"))
    seconds = stretches.groupBy(*own).agg(
        F.coalesce(F.max(F.when(lead, F.col("failures"))), F.lit(0)).alias("lead"),
        F.coalesce(F.max(F.when(later, F.col("failures"))), F.lit(0)).alias("run"),
        F.when(F.max("ended"), F.coalesce(F.max(F.when(~F.col("ended"), F.col("failures"))), F.lit(0))).alias("tail"),
    )
    cut = _segments(seconds, "username", "ts", LOCK_SECONDS, False)
    counted = _transitions(cut, "username", ["lead", "run", "tail"], lambda: (0, 0), pass_second, "failures")
    locked = (F.col("failures") + F.col("_lead") >= LOCK_FAILURES) | (F.col("_longest") >= LOCK_FAILURES)
    return rows.join(counted, own).select("username", "ts", "event_id", "ok", locked.alias("locked"))


class _PerUser(StatefulProcessor):
    """State of a user in a list, dropped by a timer once it cannot matter any more.

    Events are decided at once, in the order in which Spark hands them over;
    within a frame of at most ``spark.sql.execution.arrow.maxRecordsPerBatch``
    rows in order of time. No more than a frame and the state is ever held.
    """

    schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.schema)

    def decide(self, state: list[tuple], now: int, row: tuple) -> tuple[bool, list[tuple]]:
        raise NotImplementedError

    def expires(self, state: list[tuple], last: int) -> int:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        last = None
        for frame in rows:
            frame = frame.sort_values(["event_time", "event_id"])
            seconds = frame["event_time"].astype("datetime64[s]").astype("int64")
            flags = []
            for now, row in zip(seconds.tolist(), frame[self.inputs].itertuples(index=False), strict=True):
                flag, state = self.decide(state, now, row)
                flags.append(flag)
            if len(frame):
                last = max(seconds.tolist()[-1], last or 0)
            yield pd.DataFrame({self.user: key[0], "event_id": frame["event_id"].values, "ts": seconds.values, self.flag: flags})
        if state:
            self.held.put(state)
        elif self.held.exists():
            self.held.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if state and last is not None:
            self.handle.registerTimer(max(self.expires(state, last) * 1000, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            self.held.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class QuotaPerUser(_PerUser):
    schema, user, flag, inputs = "ts long, n long", "user_id", "admitted", ["event_id"]

    def __init__(self, limit: int) -> None:
        self.limit = limit

    def decide(self, state, now, row):
        free, state = admit(state, now, 1, self.limit)
        return free > 0, state

    def expires(self, state, last):
        return max(last, state[-1][0]) + WINDOW_SECONDS + 1


class LockPerUser(_PerUser):
    schema, user, flag, inputs = "failures long, start long", "username", "locked", ["ok"]

    def decide(self, state, now, row):
        ok = bool(row[0])
        before, after = pass_second(state[0] if state else (0, 0), now, int(not ok), 0, 0 if ok else None)
        return before >= LOCK_FAILURES, [after] if after[0] else []

    def expires(self, state, last):
        return max(last, state[0][1]) + LOCK_SECONDS


def _stream(events: DataFrame, processor: _PerUser, delay: str) -> DataFrame:
    schema = f"{processor.user} long, event_id long, ts long, {processor.flag} boolean"
    return events.withWatermark("event_time", delay).groupBy(processor.user).transformWithStateInPandas(processor, schema, "append", "eventTime")


def quota_stream(events: DataFrame, limit: int = CHAT_LIMIT, delay: str = "1 hour") -> DataFrame:
    """J14 on a stream ``(user_id, event_time, event_id)``; state is at most ``limit`` rows per user.

    Events older than the watermark are dropped by Spark and show in the
    query's ``numRowsDroppedByWatermark`` metric. Needs the RocksDB state store
    that ``session.configure`` sets.
    """
    return _stream(events, QuotaPerUser(max(1, limit)), delay)


def lockout_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """J15 on a stream ``(username, event_time, event_id, ok)``; one row of state per user with failures."""
    return _stream(events, LockPerUser(), delay)

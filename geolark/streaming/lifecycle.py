"""The life cycle of queries and the daily cap as stateful streams: typed state and event-time timers, a row of state a key."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: A query without an answer has failed after so many hours; events of a day that are let through.
TIMEOUT_HOURS, DAILY_CAP = 6, 5000
COMPLETED, FAILED, TIMED_OUT, PENDING = "completed", "failed", "timed out", "pending"
_EPOCH = datetime.datetime(1970, 1, 1)


def _state_store(df: DataFrame) -> None:
    """Typed state and timers need the RocksDB store; streams that are started from now on use it."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LifeCycle(StatefulProcessor):
    """Per query: since when it is pending, then how it ended. A timer ends one that gets no answer."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("query", "since long, status string, at long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        events = sorted((r.ms, r.event_id, r.status) for r in rows)
        known = self.state.get() if self.state.exists() else None
        since, status, at = known or (events[0][0], PENDING, events[0][0])
        if known is None:
            self.handle.registerTimer(since + self.timeout_ms)
        for ms, _, answer in events:
            if status == PENDING and answer is not None and ms <= since + self.timeout_ms:
                status, at = answer, ms
                self.handle.deleteTimer(since + self.timeout_ms)
        self.state.update((since, status, at))
        if known is None or status != known[1]:
            yield Row(query_id=key[0], since_ms=since, status=status, at_ms=at)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        since, status, _ = self.state.get()
        if status == PENDING:
            self.state.update((since, TIMED_OUT, since + self.timeout_ms))
            yield Row(query_id=key[0], since_ms=since, status=TIMED_OUT, at_ms=since + self.timeout_ms)

    def close(self) -> None:
        pass


def life_cycle(events: DataFrame, timeout_hours: int = TIMEOUT_HOURS, late: str = "1 hour") -> DataFrame:
    """(query_id, since_ms, status, at_ms): a row for each change of a query, from a stream (query_id, event_id, ts, status).

    A query is pending from its first event; the first event with a status (completed, failed) up to `timeout_hours` after it ends it, and
    without one the watermark does. Events of a batch count by time, batches as they come; events behind the watermark are dropped as late, and those of an ended query change nothing.
    """
    _state_store(events)
    keyed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).withColumn("ms", F.unix_millis("ts"))
    return keyed.groupBy("query_id").transformWithState(LifeCycle(timeout_hours * 3_600_000), "query_id string, since_ms long, status string, at_ms long", "Update", "EventTime")


class Cap(StatefulProcessor):
    """Per day: how many events were let through. The count goes when the watermark has passed the day's end."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        if self.count.exists():
            n = self.count.get()[0]
        else:
            n = 0
            self.handle.registerTimer(int((datetime.datetime.combine(key[0], datetime.time()) - _EPOCH).total_seconds() * 1000) + 86_400_000)
        for _, event_id in sorted((r.us, r.event_id) for r in rows):
            if n == self.cap:
                break
            n += 1
            yield Row(day=key[0], event_id=event_id, n=n)
        self.count.update((n,))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


def capped(events: DataFrame, cap: int = DAILY_CAP, late: str = "1 hour") -> DataFrame:
    """(day, event_id, n): the events let through, the n-th of their UTC day, from a stream (event_id, ts).

    The count of a day is one key. Each task of a batch hands on no more than the first `cap` of its events of a day, as the others can't
    be let through; so what meets at the key grows with tasks, not with events. Events that come after their day's count is gone are dropped as late.
    """
    _state_store(events)

    def first_ones(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for t in parts:
            both = t if kept is None else pd.concat([kept, t])
            kept = both.sort_values(["day", "ts", "event_id"]).groupby("day").head(cap)
        if kept is not None:
            yield kept

    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))
    few = rows.withColumn("day", F.to_date(F.to_utc_timestamp("ts", F.current_timezone()))).mapInPandas(first_ones, "ts timestamp, event_id long, day date")
    keyed = few.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))
    return keyed.groupBy("day").transformWithState(Cap(cap), "day date, event_id long, n long", "Append", "EventTime")

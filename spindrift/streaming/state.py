"""Keyed state in streams: a limiter, a cache with a time to live, and the states of jobs.

Each is a processor with a value for each key and a timer that lets go of it. Events of a key that
come in one batch are put in order first, so a stream that reads a table in one batch, or in order of
time, gives what the batch query gives.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Timers and values need the store that keeps state on disk; the session's setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class Keyed(StatefulProcessor):
    """A value for each key, of the schema ``STATE``; events ``(key, seconds, event_id, ...)`` in order."""

    STATE = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", self.STATE)

    def ordered(self, rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
        """The events of a key in a batch; a batch is bounded by the stream's trigger."""
        return pd.concat(list(rows)).sort_values(["seconds", "event_id"], kind="stable")

    def keep_until(self, seconds: int) -> None:
        """Let go of the value once the watermark has passed; an earlier timer is put off."""
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer if isinstance(timer, int) else timer[0])
        self.handle.registerTimer(int(seconds) * 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        """Nothing is open."""


class Limiter(Keyed):
    """The first ``limit`` calls of a caller in each window of ``window`` seconds are admitted."""

    STATE = "bucket long, n long"
    OUT = "key string, event_id long, bucket long, admitted boolean"

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        bucket, n = self.value.get() if self.value.exists() else (None, 0)
        out = []
        events = self.ordered(rows)
        for seconds, event in zip(events["seconds"], events["event_id"], strict=True):
            own = int(seconds) // self.window
            n = n + 1 if own == bucket else 1
            bucket = own
            out.append((key[0], int(event), own, n <= self.limit))
        self.value.update((bucket, n))
        self.keep_until((bucket + 1) * self.window)
        yield pd.DataFrame(out, columns=["key", "event_id", "bucket", "admitted"])


class Cache(Keyed):
    """A miss whose result may be cached writes an entry for ``ttl`` seconds; a hit does not renew it."""

    STATE = "until long"
    OUT = "key string, seconds long, event_id long, hit boolean"

    def __init__(self, ttl: int):
        self.ttl = ttl

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        until = self.value.get()[0] if self.value.exists() else -1
        events, hits = self.ordered(rows), []
        for seconds, cacheable in zip(events["seconds"], events["cacheable"], strict=True):
            hit = bool(seconds < until)
            if not hit and cacheable:
                until = int(seconds) + self.ttl
            hits.append(hit)
        if until >= 0:
            self.value.update((until,))
            self.keep_until(until)
        yield pd.DataFrame({"key": key[0], "seconds": events["seconds"], "event_id": events["event_id"], "hit": hits})


class Jobs(Keyed):
    """The state of a job after each batch: processing, done or error.

    A job that ended stays as it ended until it is started again. States are let go of ``kept`` seconds
    after the last event; a job asked for then, or never seen, is unknown.
    """

    STATE = "status string, seconds long, event_id long"
    OUT = "key string, status string, seconds long, event_id long"
    NEXT = {"started": "processing", "finished": "done", "failed": "error"}

    def __init__(self, kept: int):
        self.kept = kept

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = self.value.get() if self.value.exists() else None
        events = self.ordered(rows)
        for seconds, event, kind in zip(events["seconds"], events["event_id"], events["kind"], strict=True):
            if kind in self.NEXT and (last is None or (int(seconds), int(event)) > (last[1], last[2])):
                last = (self.NEXT[kind], int(seconds), int(event))
        if last is not None:
            self.value.update(tuple(last))
            self.keep_until(last[1] + self.kept)
            yield pd.DataFrame([(key[0], *last)], columns=["key", "status", "seconds", "event_id"])


def keyed(events: DataFrame, processor: Limiter | Cache | Jobs, late: str = "10 minutes") -> DataFrame:
    """The processor's rows for a stream of events with ``key``, ``seconds`` and ``event_id``."""
    timed = events.withColumn("at", F.timestamp_seconds("seconds")).withWatermark("at", late)
    return timed.groupBy("key").transformWithStateInPandas(processor, processor.OUT, "append", "eventTime")


def latest_status(events: DataFrame) -> DataFrame:
    """The batch twin of ``Jobs``: ``(key, status)`` of every job with an event that counts."""
    status = F.element_at(F.create_map(*[F.lit(x) for pair in Jobs.NEXT.items() for x in pair]), F.col("kind"))
    known = events.where(F.col("kind").isin(*Jobs.NEXT)).withColumn("status", status)
    return known.groupBy("key").agg(F.max_by("status", F.struct("seconds", "event_id")).alias("status"))

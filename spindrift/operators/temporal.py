"""Counters, caches and sessions over time: the batch forms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def admit(calls: DataFrame, caller: str, seconds: Column, order: list, limit: int, window: int) -> DataFrame:
    """Add ``bucket`` and ``admitted``: the first ``limit`` calls of a caller in each window of time."""
    out = calls.withColumn("bucket", F.floor(seconds / window))
    w = Window.partitionBy(caller, "bucket").orderBy(*order)
    return out.withColumn("admitted", F.row_number().over(w) <= limit)


def may_cache(ok: Column, served: Column, nominal: Column) -> Column:
    """A result may be cached if it is one and what served it is what its key names; one that no index served is safe."""
    return F.coalesce(ok, F.lit(False)) & (served.isNull() | F.coalesce(served == nominal, F.lit(False)))


def cache_hits(events: DataFrame, ttl: int) -> DataFrame:
    """Add ``hit`` to events ``(key, seconds, event_id, cacheable)``.

    A miss writes an entry that lives ``ttl`` seconds, if the result may be cached; a hit does not
    renew it. Events are dealt out by key and sorted, and a fold reads them in order with one number
    for the current key, so a key with any number of events needs no memory.
    """
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = events.select("key", "seconds", "event_id", "cacheable").repartition(parts, "key").sortWithinPartitions("key", "seconds", "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, until = None, 0
        for batch in batches:
            hits = []
            for k, t, cacheable in zip(batch["key"], batch["seconds"], batch["cacheable"], strict=True):
                if k != key:
                    key, until = k, -1
                hit = t < until
                if not hit and cacheable:
                    until = t + ttl
                hits.append(hit)
            yield batch[["key", "seconds", "event_id"]].assign(hit=hits)

    return ordered.mapInPandas(fold, "key string, seconds long, event_id long, hit boolean")

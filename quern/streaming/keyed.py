"""Streaming forms: first id wins, last writer wins, and change capture folded per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_ids(events: DataFrame, key: str, stamp: str, keep: str = "7 days") -> DataFrame:
    """The first event of every id within the time that ids are remembered."""
    return events.withWatermark(stamp, keep).dropDuplicatesWithinWatermark([key])


def counts(events: DataFrame, stamp: str, every: str, late: str, *keys: str) -> DataFrame:
    """Events per window and key; late rows within ``late`` still count."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, every), *keys).agg(F.count(F.lit(1)).alias("events"))


def last_writes(events: DataFrame, key: str, state: str, version: str) -> DataFrame:
    """The state of each key's greatest version so far (complete or update mode)."""
    return events.groupBy(key).agg(F.max_by(state, version).alias(state), F.max(version).alias(version))


def deliver(events: DataFrame, sink: Callable[[DataFrame, int], None], admits: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Push each batch of admitted changes to a sink; a filter that fails withholds its batch."""

    def push(batch: DataFrame, number: int) -> None:
        sink(admits(batch), number)

    return events.writeStream.foreachBatch(push).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

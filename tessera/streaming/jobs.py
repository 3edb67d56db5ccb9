"""Stateful queries over streams of events; each also runs over a table, where watermarks have no effect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_seen(events: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first event of each key. Over a stream a key is remembered for the delay behind the newest event, so state stays bounded."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def windowed(events: DataFrame, at: str, width: str, delay: str, keys: list[str], **counts: Column) -> DataFrame:
    """begin, keys, n and further aggregates of each window of time; events more than the delay behind the newest are late and left out."""
    rows = events.withWatermark(at, delay)
    out = rows.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in counts.items()])
    return out.select(F.col("w.start").alias("begin"), *keys, "n", *counts)


def sessions(events: DataFrame, user: str, at: str, gap: str, delay: str) -> DataFrame:
    """user, begin, end, n of each run of a user's events with less than the gap between neighbours; end is the gap after the last."""
    rows = events.withWatermark(at, delay)
    out = rows.groupBy(user, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(user, F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What has arrived so far, in micro-batches, appended to files once each; a restart goes on behind the last batch written."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def in_batches(source: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, seconds: float) -> bool:
    """Run apply on a source's micro-batches (maxFilesPerTrigger sets their size) for so long, or until nothing is left: then True.

    A run that stops or dies goes on from its checkpoint with the batch that it didn't finish, under the same number: apply commits by it.
    """
    query = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        return query.awaitTermination(seconds)
    finally:
        query.stop()

"""The limit of hits in windows that begin with a hit, over a stream: a key's state is when its window began and how many it took."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _FirstHit(StatefulProcessor):
    def __init__(self, order: str, seconds: int, most: int, columns: list[str]) -> None:
        self.order, self.length, self.most, self.columns = order, seconds * 1_000_000, most, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "began long, taken long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        began, taken = self.window.get() if self.window.exists() else (None, 0)
        hits = pd.concat(list(rows))  # those of one micro-batch
        hits.columns = [*self.columns, "_t"]  # Spark renames columns that begin with an underscore
        hits = hits.sort_values(["_t", self.order])
        allowed = []
        for at in hits["_t"]:
            if began is None or at - began > self.length:
                began, taken = int(at), 0
                self.handle.registerTimer(began // 1000 + self.length // 1000 + 1)
            taken += 1
            allowed.append(taken <= self.most)
        self.window.update((began, taken))
        yield hits[self.columns].assign(allowed=allowed)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.window.exists():
            began, _ = self.window.get()
            if began + self.length < timerValues.getCurrentWatermarkInMs() * 1000:
                self.window.clear()  # no row that still comes in time can fall into it
        return iter([])

    def close(self) -> None:
        pass


def first_hit_limit(events: DataFrame, key: str, time: str, order: str, seconds: int, most: int, delay: str) -> DataFrame:
    """events of a stream with allowed, as operators.limits gives it over a table, if rows come in order from one micro-batch to the next.

    A micro-batch's rows of a key are put in order. Rows more than `delay` behind the newest one are late and left out (streaming.apart
    keeps them); rows without a key or time must be taken out before. State goes when the watermark passes a window's end. Needs the
    RocksDB state store.
    """
    rows = events.withWatermark(time, delay).withColumn("_t", F.unix_micros(time))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema) + ", allowed boolean"
    processor = _FirstHit(order, seconds, most, events.columns)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")

"""Rows of a stream kept apart by their time: in time, late, too old, future and undated ones each in a table of their own, and counted."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.streaming.commits import Marks

SIDES = ("in_time", "late", "too_old", "future", "undated")


def side(at: Column, now: Column, newest: Column, delay: str, ahead: str, oldest: str) -> Column:
    """The side of a time: undated if null, future if more than `ahead` of now, too_old if more than `oldest` behind now, late if more
    than `delay` behind the newest time seen before (null: none seen), else in_time. Lengths are intervals such as '2 hours'."""
    length = lambda x: F.expr(f"INTERVAL {x}")
    dated = F.when(at > now + length(ahead), "future").when(at < now - length(oldest), "too_old").when(at < newest - length(delay), "late").otherwise("in_time")
    return F.when(at.isNull(), "undated").otherwise(dated)


def split(stream: DataFrame, at: str, out: str, checkpoint: str, delay: str, ahead: str, oldest: str, now: Callable[[], datetime]) -> StreamingQuery:
    """Write what has arrived to out, by batch and side, without loss: a watermark of Spark's own would drop late rows without a word.

    A batch is measured against the newest time that batches before it had in time, so its rows' own order plays no part, and future
    rows don't push the watermark. A batch counts when its marker is there; one that is run again overwrites what it wrote before.
    """
    spark = stream.sparkSession
    marks = Marks(spark, f"{out}/marks")

    def apply(batch: DataFrame, number: int) -> None:
        before = marks.last(below=number)
        if marks.last() >= number:
            return
        newest = marks.get(before)["newest"] if before >= 0 else None
        clock = F.timestamp_micros(F.lit(round(now().timestamp() * 1_000_000)))
        seen = F.timestamp_micros(F.lit(newest).cast("long"))
        batch.withColumn("side", side(F.col(at).cast("timestamp"), clock, seen, delay, ahead, oldest)).write.mode("overwrite").partitionBy("side").parquet(f"{out}/rows/batch={number}")
        counts = {s: 0 for s in SIDES}
        latest = newest
        if marks.files.globStatus(marks.hadoop.Path(f"{out}/rows/batch={number}/side=*")):
            written = spark.read.parquet(f"{out}/rows/batch={number}")
            for r in written.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.max(F.unix_micros(F.col(at).cast("timestamp"))).alias("max")).collect():  # a row a side
                counts[r["side"]] = r["n"]
                if r["side"] == "in_time":
                    latest = max(r["max"], latest if latest is not None else r["max"])
        marks.put(number, {"newest": latest, "counts": counts})

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(spark: SparkSession, out: str, wanted: str, schema: str) -> DataFrame:
    """The rows of one side, of batches that count."""
    marks = Marks(spark, f"{out}/marks")
    paths = [f"{out}/rows/batch={n}/side={wanted}" for n in range(marks.last() + 1) if marks.get(n)["counts"][wanted]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def counted(spark: SparkSession, out: str) -> dict[str, int]:
    """How many rows each side has."""
    marks = Marks(spark, f"{out}/marks")
    each = [marks.get(n)["counts"] for n in range(marks.last() + 1)]
    return {s: sum(c[s] for c in each) for s in SIDES}

"""Counts over sliding horizons of days, distinct keys included, from one pass: what each day adds and what leaves with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding(rows: DataFrame, day: Column, key: str, horizons: list[int], last: Column) -> DataFrame:
    """day, horizon, n, keys: of each day up to `last` and each horizon, the rows and the distinct keys of the horizon's days that end with it.

    A day of a key counts until the key's next day or the horizon's end, whichever is first, so that horizons that overlap share one
    row a key and day, and every key is counted once in each. Rows without a day count nowhere, those without a key in n only; days
    before the first row have no line. The last step sums over days, of which there are few; a key's days are ordered by themselves.
    """
    by_day = rows.select(day.alias("day"), F.col(key).alias("key")).where("day IS NOT NULL").groupBy("day", "key").agg(F.count(F.lit(1)).alias("n"))
    following = F.lead("day").over(Window.partitionBy("key").orderBy("day"))
    marked = by_day.withColumn("next", F.when(F.col("key").isNotNull(), following))
    spread = marked.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    out, known = F.date_add("day", F.col("horizon")), F.col("key").isNotNull().cast("long")
    steps = F.array(F.struct("day", F.col("n").alias("n"), known.alias("keys")), F.struct(out.alias("day"), (-F.col("n")).alias("n"), F.lit(0).cast("long").alias("keys")), F.struct(F.least("next", out).alias("day"), F.lit(0).cast("long").alias("n"), (-known).alias("keys")))
    changes = spread.select("horizon", F.inline(steps)).groupBy("horizon", "day").agg(F.sum("n").alias("n"), F.sum("keys").alias("keys"))
    first = rows.agg(F.min(day).alias("first"))
    days = first.select(F.explode(F.sequence("first", last)).alias("day")).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons])))
    each = days.join(changes, ["horizon", "day"], "left").na.fill(0, ["n", "keys"])
    upto = Window.partitionBy("horizon").orderBy("day")
    return each.select("day", "horizon", F.sum("n").over(upto).alias("n"), F.sum("keys").over(upto).alias("keys"))

"""A limit of hits a key in windows that begin with a hit: the first hit opens one, the first hit after it has run out opens the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tables import held


def _following(times: DataFrame, length: int) -> DataFrame:
    """k, t, n: for each time of a key the first one more than `length` after it, where there is one. A bucket is `length` long.

    It lies in the next bucket, or it is the first time of the next bucket after that which has any. So times are ordered within
    buckets only, and buckets within a key.
    """
    by_key = Window.partitionBy("k").orderBy("b")
    firsts = times.groupBy("k", "b").agg(F.min("t").alias("first"))
    ahead = firsts.select("k", "b", *[F.lead(c, i).over(by_key).alias(f"{c}{i}") for c in ("b", "first") for i in (1, 2)])
    beyond = ahead.select("k", "b", F.when(F.col("b1") == F.col("b") + 1, F.col("first2")).otherwise(F.col("first1")).alias("beyond"))
    asks = times.select("k", (F.col("b") + 1).alias("b"), (F.col("t") + length).alias("x"), F.col("t").alias("asks"))
    both = asks.unionByName(times.select("k", "b", F.col("t").alias("x"), F.lit(None).cast("long").alias("asks")))
    later = Window.partitionBy("k", "b").orderBy(F.desc("x")).rangeBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("near", F.min(F.when(F.col("asks").isNull(), F.col("x"))).over(later)).where("asks IS NOT NULL")
    found = near.select("k", (F.col("b") - 1).alias("b"), F.col("asks").alias("t"), "near").join(beyond, ["k", "b"])
    return found.select("k", "t", F.coalesce("near", "beyond").alias("n")).where("n IS NOT NULL")


def window_starts(times: DataFrame, length: int) -> DataFrame:
    """k, t: the times at which a window begins, of distinct times (k, t, b).

    Each round doubles how many windows lie behind a pointer, so a key with n windows takes about log2 n rounds, and no key is walked through.
    """
    starts = held(times.groupBy("k").agg(F.min("t").alias("t")))
    pointers = held(_following(times, length))
    known = starts.count()
    while True:
        new = starts.join(pointers, ["k", "t"]).select("k", F.col("n").alias("t"))
        starts = held(starts.unionByName(new).distinct())
        if (now := starts.count()) == known:
            return starts
        known = now
        further = pointers.select("k", F.col("t").alias("n"), F.col("n").alias("further"))
        pointers = held(pointers.join(further, ["k", "n"]).select("k", "t", F.col("further").alias("n")))


def first_hit_limit(rows: DataFrame, key: str, time: str, order: str, seconds: int, most: int) -> DataFrame:
    """rows with allowed: whether a row is among the first `most` of its key's window, by time, then by `order`.

    A window begins with a hit and holds what comes up to `seconds` after it; the next hit begins another one. Rows without a key or a
    time are not limited: allowed is null. Equal times count one after the other. A window of any number of hits keeps only `most` in
    order; a key of any number of windows is no task of its own.
    """
    length = seconds * 1_000_000
    t = F.unix_micros(F.col(time).cast("timestamp"))
    marked = rows.withColumns({"_k": F.col(key), "_t": t, "_b": F.floor(t / length)})
    hits = marked.where("_k IS NOT NULL AND _t IS NOT NULL")
    times = held(hits.select(F.col("_k").alias("k"), F.col("_t").alias("t"), F.col("_b").alias("b")).distinct())
    # no two windows begin in one bucket, so a hit's window begins in its bucket or in the one before
    starts = window_starts(times, length).withColumn("b", F.floor(F.col("t") / length))
    own = starts.select(F.col("k").alias("_k"), F.col("b").alias("_b"), F.col("t").alias("_own"))
    before = starts.select(F.col("k").alias("_k"), (F.col("b") + 1).alias("_b"), F.col("t").alias("_before"))
    placed = marked.join(own, ["_k", "_b"], "left").join(before, ["_k", "_b"], "left")
    placed = placed.withColumn("_start", F.when(F.col("_own") <= F.col("_t"), F.col("_own")).otherwise(F.col("_before"))).drop("_own", "_before")
    place = F.row_number().over(Window.partitionBy("_k", "_start").orderBy("_t", order))
    first = placed.where("_start IS NOT NULL").select("_k", "_start", "_t", order).withColumn("_place", place).where(F.col("_place") <= most)
    last = first.groupBy("_k", "_start").agg(F.max(F.struct("_t", order)).alias("_last"))
    out = placed.join(last, ["_k", "_start"], "left")
    return out.select(*[F.col(c) for c in rows.columns], (F.struct("_t", order) <= F.col("_last")).alias("allowed"))

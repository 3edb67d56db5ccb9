"""Scores by parts, merges that keep decisions, conflicts and outboxes."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def points(parts: list[tuple[Column, float]]) -> Column:
    """The sum of the points whose test is true."""
    return reduce(add, [F.when(test, F.lit(n)).otherwise(F.lit(n * 0)) for test, n in parts])


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by an order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def merged(old: DataFrame, new: DataFrame, keys: list[str], locked: Column) -> DataFrame:
    """Upsert by key: new rows win unless the old one is locked, a test on columns of old; blanks never overwrite. Keys are unique in both."""
    values = [c for c in old.columns if c not in keys]
    left = old.withColumn("_locked", F.coalesce(locked, F.lit(False)))
    right = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in values])
    both = left.join(right, keys, "full_outer")
    keep = F.coalesce(F.col("_locked"), F.lit(False))
    return both.select(*keys, *[F.when(keep, F.col(c)).otherwise(F.coalesce(f"_new_{c}", c)).alias(c) for c in values])


def conflicts(old: DataFrame, new: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys, field, old, new: a row for each field of which both sides hold different values; nothing is overwritten."""
    both = old.alias("o").join(new.alias("n"), keys)
    pair = [F.struct(F.lit(f).alias("field"), F.col(f"o.{f}").cast("string").alias("old"), F.col(f"n.{f}").cast("string").alias("new")) for f in fields]
    rows = both.select(*keys, F.explode(F.array(*pair)).alias("_p")).select(*keys, "_p.*")
    return rows.where("old <> new")


def not_sent(pairs: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that no delivery has yet, each once."""
    return pairs.dropDuplicates(keys).join(sent, keys, "left_anti")

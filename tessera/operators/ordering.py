"""What depends on an order within a key. Each takes the order explicitly: rows of a table have none of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str | Column], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(window)).where("_rn = 1").drop("_rn")


def most_recent(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= n).drop("_rn")


def blocks(rows: DataFrame, keys: list[str], order: list[str], is_head: Column, name: str = "block") -> DataFrame:
    """Numbers the blocks of each key: a head begins one that lasts until the next; rows before the first head are block 0."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(F.when(is_head, 1).otherwise(0)).over(upto))


def transitions(rows: DataFrame, keys: list[str], order: list[str], state: str, into: str) -> DataFrame:
    """Rows whose state is `into` and was another one, known, before."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("previous", F.lag(state).over(window)).where((F.col(state) == into) & F.col("previous").isNotNull() & (F.col("previous") != into))


def rotating(rows: DataFrame, order: list[Column], count: int, tick: int, size: int) -> DataFrame:
    """The slice of `size` rows that it is the turn of at a tick; count is the number of rows."""
    turns = max(1, -(-count // size))
    return rows.orderBy(*order).offset(tick % turns * size).limit(size)

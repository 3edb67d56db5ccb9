"""Connected components of a graph whose links are a table, by alternating stars; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop_cut


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """id, label: for each id in links (a, b, both bigint) the smallest id that it reaches.

    A large star joins the larger neighbours of a node to its smallest one, a small star the smaller ones; both keep the components.
    When no edge changes, each component is a star around its smallest id. A node's neighbours are aggregated by partial minima and
    its edges rewritten by a join that Spark may split, so a node of any degree is no burden on one task.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 8)
    before = None
    while True:
        both = _directed(edges)
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), 8)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("a"), F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        new = cut(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), 8)
        drop_cut(edges)
        drop_cut(large)
        edges = new
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("label")).union(roots)

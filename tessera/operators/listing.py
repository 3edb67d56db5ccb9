"""Pages of filtered listings: order, offset, limit, and counts of what the filters leave."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Page:
    number: int
    size: int

    @property
    def offset(self) -> int:
        return (self.number - 1) * self.size


def page_of(number: object = 1, size: object = 40, most: int = 100) -> Page:
    """Whole numbers from 1 on; what can't be read is the default."""

    def whole(x: object, default: int) -> int:
        try:
            return max(1, int(str(x)))
        except ValueError:
            return default

    return Page(whole(number, 1), min(most, whole(size, 40)))


def page(rows: DataFrame, order: list[Column], at: Page) -> DataFrame:
    """One page. The order must be total, so that pages neither overlap nor miss rows."""
    return rows.orderBy(*order).offset(at.offset).limit(at.size)


def page_info(rows: DataFrame, at: Page) -> DataFrame:
    """total, pages (1 at least), has_next of the rows that the filters leave."""
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / at.size)).cast("bigint")
    return rows.agg(F.count(F.lit(1)).alias("total")).select("total", pages.alias("pages"), (F.lit(at.number) < pages).alias("has_next"))


def sections(parts: dict[str, tuple[DataFrame, list[Column], int]], columns: list[str]) -> DataFrame:
    """The first rows of several listings, tagged by section."""
    tagged = [df.orderBy(*order).limit(n).select(F.lit(name).alias("section"), *columns) for name, (df, order, n) in parts.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df)
    return out


def best(rows: DataFrame, score: str, least: float, order: list[Column], n: int, strict: bool = False) -> DataFrame:
    """The n best of the rows whose score reaches least, or passes it."""
    test = F.col(score) > least if strict else F.col(score) >= least
    return rows.where(test).orderBy(*order).limit(n)

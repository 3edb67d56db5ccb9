"""Group aggregates. All aggregate partially before they shuffle, and none gathers a group's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding with halves toward plus infinity."""
    return F.floor(x * 10**digits + 0.5) / 10**digits if digits else F.floor(x + 0.5)


def middle(rows: DataFrame, keys: list[Column], value: Column, verified: Column | None = None) -> DataFrame:
    """The keys and least, lower, upper (the two middle values, equal where n is odd), most, n, n_verified of each group's known values.

    Values are counted first, so a group's rows are never together; its distinct values pass in order through a sort that may spill.
    """
    ok = verified if verified is not None else F.lit(False)
    counted = rows.where(value.isNotNull()).groupBy(*keys, value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"), F.count_if(ok).alias("_ok"))
    names = counted.columns[: len(keys)]
    own = Window.partitionBy(*names)
    upto = F.sum("_c").over(own.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.withColumns({"_upto": upto, "_n": F.sum("_c").over(own)})
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_v")))
    return placed.groupBy(*names).agg(
        F.min("_v").alias("least"), at(F.floor((F.col("_n") + 1) / 2)).alias("lower"), at(F.floor(F.col("_n") / 2) + 1).alias("upper"),
        F.max("_v").alias("most"), F.sum("_c").alias("n"), F.sum("_ok").alias("n_verified"),
    )


def spread(rows: DataFrame, keys: list[Column], value: Column, verified: Column, order: Column, top: int | None = None, beside: list[Column] | None = None) -> DataFrame:
    """least, most, median (halves up), n, n_verified of the positive values of each group, and aggregates beside them; the largest groups first."""
    out = middle(rows.where(value > 0), keys, value, verified)
    if beside:
        names = out.columns[: len(keys)]
        more = rows.where(value > 0).groupBy(*keys).agg(*beside)
        more = more.select(*[F.col(n).alias(f"_{n}") for n in names], *more.columns[len(keys) :])
        same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
        out = out.join(more, same).drop(*[f"_{n}" for n in names])
    out = out.withColumn("median", half_up((F.col("lower") + F.col("upper")) / 2).cast("bigint")).drop("lower", "upper")
    return out.orderBy(F.col("n").desc(), order).limit(top) if top else out


def rating(value: Column) -> Column:
    """Mean to one decimal over the known values."""
    return half_up(F.avg(value), 1)


def per_cent(flag: Column) -> Column:
    """Whole per cent of the known flags that are true."""
    return half_up(100 * F.avg(flag.cast("int"))).cast("bigint")


def conditional_counts(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Any number of counts in one pass."""
    return rows.agg(*[F.count_if(test).alias(name) for name, test in tests.items()])


def facets(rows: DataFrame, columns: list[str], measure: str) -> DataFrame:
    """facet, value, n, total for each value of each column, and the total as facet "all", in one pass by grouping sets."""
    sets = [[F.col(c)] for c in columns] + [[]]
    grouped = rows.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("total"), F.grouping_id(*columns).alias("g"))
    bits = {c: (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)}
    facet, value = F.lit("all"), F.lit(None).cast("string")
    for c, bit in bits.items():
        facet, value = F.when(F.col("g") == bit, c).otherwise(facet), F.when(F.col("g") == bit, F.col(c).cast("string")).otherwise(value)
    return grouped.select(facet.alias("facet"), value.alias("value"), "n", "total")


def rate(a: Column, b: Column, per: int, digits: int) -> Column:
    """a per so many b; null without any b."""
    return F.when(b > 0, half_up(a * per / b, digits))


def rolled_up(states: list[tuple[str, Column]], otherwise: str) -> Column:
    """The first state whose aggregate test holds for the group."""
    out = F.lit(otherwise)
    for label, test in reversed(states):
        out = F.when(test, label).otherwise(out)
    return out


def duplicated(rows: DataFrame, key: Column, name: str) -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

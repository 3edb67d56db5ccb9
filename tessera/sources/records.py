"""Rows from JSON records: fields under several spellings, collections of which one may be absent, imports with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spelled(json: Column, fields: dict[str, list[str]]) -> list[Column]:
    """A string column for each field: the first of its paths whose value isn't empty."""
    value = lambda path: F.nullif(F.btrim(F.get_json_object(json, path)), F.lit(""))
    return [F.coalesce(*[value(p) for p in paths]).alias(name) for name, paths in fields.items()]


def stacked(first: DataFrame | None, second: DataFrame | None, key: str) -> DataFrame:
    """The rows of two collections, missing columns null; of a key that both have only the first's. One of the two may be absent, not both.

    Rows without a key are all kept: they repeat nothing.
    """
    if first is None or second is None:
        return second if first is None else first
    return first.unionByName(second.join(first.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti"), allowMissingColumns=True)


def imported(rows: DataFrame, json: str, required: list[str], whole: list[str]) -> DataFrame:
    """rows with reason: no JSON object, a required field that is empty, or one that should be a whole number and isn't; null where all is well."""
    value = lambda name: F.get_json_object(json, f"$.{name}")
    broken = ~F.coalesce(F.try_parse_json(json).isNotNull() & F.btrim(json).startswith("{"), F.lit(False))
    missing = [F.when(F.coalesce(F.btrim(value(n)), F.lit("")) == "", F.lit(f"{n} is missing")) for n in required]
    wrong = [F.when(value(n).isNotNull() & ~value(n).rlike(r"^-?\d+$"), F.lit(f"{n} is no number")) for n in whole]
    return rows.withColumn("reason", F.coalesce(F.when(broken, "no object"), *missing, *wrong))


def sitemap_entry(link: Column, day: Column) -> Column:
    """An entry of a site's map, the link escaped, without a day where none is known."""
    plain = F.replace(F.replace(F.replace(link, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    told = F.when(day.isNotNull(), F.concat(F.lit("<lastmod>"), F.date_format(day, "yyyy-MM-dd"), F.lit("</lastmod>"))).otherwise("")
    return F.concat(F.lit("<url><loc>"), plain, F.lit("</loc>"), told, F.lit("</url>"))

"""Dates, numbers, lists and JSON, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR = 3_600_000


def freshness(age: Column) -> Column:
    """Class of an age in milliseconds: up to two hours ahead is no future; a day is fresh, 30 days are backup."""
    return F.when(age.isNull(), "unknown").when(age < -2 * HOUR, "future").when(age <= 24 * HOUR, "fresh").when(age <= 720 * HOUR, "backup").otherwise("too_old")


def age_text(age: Column) -> Column:
    steps = [("month", 720 * HOUR, None), ("week", 168 * HOUR, 720 * HOUR), ("day", 24 * HOUR, 168 * HOUR), ("hour", HOUR, 24 * HOUR), ("min", 60_000, HOUR)]
    parts = [F.when(age >= unit, F.concat(F.floor(age / unit).cast("string"), F.lit(f" {name}"))) for name, unit, _ in steps]
    return F.coalesce(*parts, F.lit("now"))


def days_left(day: Column, today: Column) -> Column:
    return F.date_diff(day, today)


def closing_soon(day: Column, today: Column, most: int = 5) -> Column:
    return F.coalesce(days_left(day, today).between(0, most), F.lit(False))


def end_of_day(day: Column) -> Column:
    return day.cast("timestamp_ntz") + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")


def local_day_start(utc: Column, zone: str) -> Column:
    """The UTC time at which the day of a UTC time began in a zone."""
    day = F.date_trunc("day", F.from_utc_timestamp(utc.cast("timestamp"), zone))
    return F.to_utc_timestamp(day, zone).cast("timestamp_ntz")


def half_up(number: Column) -> Column:
    """Halves go towards plus infinity."""
    return F.floor(number + 0.5)


def monthly(amount: Column) -> Column:
    """Below 1000 in thousands, below 120000 a month, else a year."""
    return F.when(amount < 1000, half_up(amount * 1000)).when(amount < 120000, half_up(amount)).otherwise(half_up(amount / 12))


def listed(column: Column, most: int) -> Column:
    """A JSON list or a text with , ; or | between: trimmed, distinct, at most `most`."""
    raw = F.coalesce(F.from_json(column, "array<string>"), F.split(column, "[,;|]"))
    return F.slice(F.array_distinct(F.filter(F.transform(raw, lambda x: F.btrim(x)), lambda x: x != "")), 1, most)


def json_field(column: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(F.try_parse_json(column), path, kind)


def filled(old: Column, new: Column) -> Column:
    """The old value unless it is blank."""
    return F.coalesce(F.nullif(F.btrim(old), F.lit("")), new)

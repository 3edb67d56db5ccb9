"""Filters of listings, as Columns: all stay inside codegen, and plain comparisons reach the scan."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(and_, conditions)


def contains(column: Column, text: str) -> Column:
    """Substring test without regard to case; nothing in text is a wildcard."""
    return F.lower(column).contains(text.lower())


def contains_in_any(columns: list[str], text: str) -> Column:
    return any_of([contains(F.col(c), text) for c in columns])


def contains_in_each(wanted: dict[str, str]) -> Column:
    """Every named field contains its text; empty texts ask for nothing."""
    return all_of([contains(F.col(c), t) for c, t in wanted.items() if t] or [F.lit(True)])


def any_value(columns: list[str], values: str, aliases: dict[str, str] | None = None, most: int = 12) -> Column:
    """Some field contains some value of a comma list, of which `most` count, or its alias."""
    asked = [v.strip() for v in values.split(",") if v.strip()][:most]
    spelled = [s for v in asked for s in dict.fromkeys((v, (aliases or {}).get(v.lower(), v)))]
    return any_of([contains(F.col(c), v) for v in spelled for c in columns]) if spelled else F.lit(True)


def not_expired(expiry: Column, now: Column) -> Column:
    return expiry.isNull() | (expiry >= now)


def first_known_not_past(columns: list[Column], now: Column) -> Column:
    """The first date that is known isn't past; none known is not expired."""
    return ~F.coalesce(F.coalesce(*columns) < now, F.lit(False))


def lifecycle(state: str, published: Column, status: Column) -> Column:
    return {
        "draft": ~published & (status != "Deleted"),
        "published": published,
        "deleted": status == "Deleted",
        "needs_edit": status == "Needs Edit",
    }[state]


def sector(column: Column, wanted: str, default: str) -> Column:
    """Rows without a sector count as the default one."""
    return (column == wanted) | column.isNull() if wanted == default else column == wanted


def none_contains(columns: list[str], words: list[str]) -> Column:
    """NOT (a OR b ...) by three-valued logic: a null field drops the row whatever the others hold."""
    return ~any_of([contains(F.col(c), w) for c in columns for w in words])


def at_most_or_unknown(column: Column, most: float) -> Column:
    return (column <= most) | column.isNull()


def at_least_or_unknown(column: Column, least: float) -> Column:
    return (column >= least) | column.isNull()


def recent(columns: list[Column], now: Column, days: int) -> Column:
    """Some date lies within the last days."""
    return any_of([c >= now - F.make_interval(days=F.lit(days)) for c in columns])


def band(column: Column, around: int, width: int = 2, open_from: int = 10, most: int = 45) -> Column:
    """Within width of a number; from open_from on, up to most."""
    low = max(0, around - width)
    return column.between(low, most if around >= open_from else around + width)


def has_all(array: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), array)) == 0


def within_days(day: Column, today: Column, days: int) -> Column:
    return day.between(today, F.date_add(today, days))


#: Hosts of the machine itself and of private ranges.
PRIVATE_HOST = r"^(localhost|127\.|10\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|0\.|\[(::1?|f[cd][0-9a-f]{2}:.*|fe80:.*|::ffff:.*)\]$)|\.localhost\.?$"
#: What precedes an @ is a user, however it looks; a host in brackets is an IPv6 address.
_HOST = r"^(?i:https?)://(?:[^/?#@\\]*@)*(\[[^\]]*\]|[^/:?#@\\]+)"


def safe_url(url: Column) -> Column:
    """http or https, and no host of the machine itself or of a private range."""
    host = F.lower(F.regexp_extract(url, _HOST, 1))
    return (host != "") & ~host.rlike(PRIVATE_HOST)


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, _HOST, 1)), r"^www\.", "")


def host_in(url: Column, suffixes: list[str]) -> Column:
    """https, and the host is one of the suffixes or below it."""
    host = host_of(url)
    return url.startswith("https://") & any_of([(host == s) | host.endswith(f".{s}") for s in suffixes])


def known(*columns: Column) -> Column:
    return all_of([c.isNotNull() & (c != "") for c in columns])


def first_reason(gates: list[tuple[str, Column]]) -> Column:
    """The label of the first gate that is true; null if none is."""
    return F.coalesce(*[F.when(test, F.lit(label)) for label, test in gates])


def flags(tests: list[tuple[str, Column]]) -> Column:
    """The labels whose tests are true, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in tests]))


def flag_score(found: Column, each: int = 15) -> Column:
    return F.greatest(F.lit(0), F.lit(100) - F.lit(each) * F.size(found))


def or_null(column: Column, test: Column) -> Column:
    """The value where it is valid."""
    return F.when(test, column)

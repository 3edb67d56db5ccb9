"""Cleaning, keys and extraction of text, as Columns; nothing here leaves codegen but the lambdas over arrays."""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track visitors.
TRACKING = r"(?i)^(utm_\w+|fbclid|gclid|msclkid|ref|source|mc_cid|mc_eid|igshid)(=|$)"


def _each(column: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda c, step: F.regexp_replace(c, *step), steps, column)


_NUMBERED = "&#(?:[xX][0-9a-fA-F]{1,5}|[0-9]{1,6});"


def numbered_entities(column: Column) -> Column:
    """References by number, decimal or hexadecimal, as the characters they stand for; numbers that no character has as U+FFFD."""
    said = F.regexp_extract_all(column, F.lit(f"({_NUMBERED})"), 1)
    digits = lambda x: F.regexp_replace(x, "[^0-9a-fA-F]", "")
    code = lambda x: F.when(F.lower(x).startswith("&#x"), F.conv(digits(x), 16, 10)).otherwise(digits(x)).cast("int")
    valid = lambda n: F.when(n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF), n).otherwise(0xFFFD)
    shown = F.concat(F.transform(said, lambda x: F.decode(F.unhex(F.lpad(F.hex(valid(code(x))), 8, "0")), "UTF-32")), F.array(F.lit("")))
    pieces = F.zip_with(F.split(column, _NUMBERED), shown, lambda a, b: F.concat(a, b))
    return F.when(column.contains("&#"), F.array_join(pieces, "")).otherwise(column)


def clean_text(column: Column) -> Column:
    """CDATA opened, entities decoded, ampersands first, so that what was escaped twice becomes a tag; tags to spaces; blanks collapsed."""
    column = numbered_entities(F.regexp_replace(column, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    plain = [("(?s)<!--.*?-->", " "), ("&amp;", "&"), ("&quot;", '"'), ("&(#39|apos);", "'"), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">")]
    return F.btrim(_each(column, [*plain, ("<[^>]*>", " "), (r"\s+", " ")]))


def norm_text(column: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(clean_text(column)), "[^a-z0-9]+", " "))


def strip_html(column: Column) -> Column:
    """Without scripts and styles; the end of a block ends the line; entities decoded last, so that what they spell stays text."""
    unseen, breaks = r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", r"(?i)</(?:p|div|li|tr|h[1-6])\s*>|<br\s*/?\s*>"
    plain = reduce(lambda c, step: F.regexp_replace(c, *step), [(unseen, " "), (breaks, "\n"), ("<[^>]*>", " ")], column)
    named = [("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")]
    shown = reduce(lambda c, pair: F.replace(c, F.lit(f"&{pair[0]};"), F.lit(pair[1])), named, numbered_entities(plain))
    return F.btrim(F.regexp_replace(F.regexp_replace(shown, r"[ \t]+", " "), r" *\n\s*", "\n"), F.lit(" \n"))


def clean_lines(column: Column, most: int = 12000) -> Column:
    """No NUL and zero-width characters, LF line ends, single blanks, at most one empty line, at most `most` characters."""
    steps = [("[\u0000​‌‍﻿]", ""), ("\r\n?", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")]
    return F.substring(F.btrim(_each(column, steps), F.lit(" \n")), 1, most)


def slug(column: Column, most: int = 100) -> Column:
    return F.btrim(F.substring(F.btrim(F.regexp_replace(F.lower(column), "[^a-z0-9]+", "-"), F.lit("-")), 1, most), F.lit("-"))


def unshouted(column: Column) -> Column:
    """Capital words only where the text is all capitals."""
    return F.when((column == F.upper(column)) & column.rlike("[A-Z]"), F.initcap(F.lower(column))).otherwise(column)


def normal_url(url: Column) -> Column:
    """Without fragment, tracking parameters and the slash at the end of a path; what is no URL loses what follows ? or #."""
    whole = F.regexp_replace(F.btrim(url), "#.*$", "")
    head = F.regexp_extract(whole, r"^([^?]*)", 1)
    kept = F.filter(F.split(F.regexp_extract(whole, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    out = F.concat(head, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    bare = F.when(F.regexp_like(out, F.lit("^https?://[^/]+/.+/$")), F.regexp_replace(out, "/$", "")).otherwise(out)
    return F.when(whole.rlike("^(?i)https?://"), bare).otherwise(F.regexp_replace(F.btrim(url), "[?#].*$", ""))


def dedupe_key(url: Column, title: Column) -> Column:
    """URL and title; the title alone is marked; empty where both are, and then nothing may be deduplicated on it."""
    u, t = F.coalesce(normal_url(url), F.lit("")), F.coalesce(norm_text(title), F.lit(""))
    return F.when((u == "") & (t == ""), "").when(u == "", F.concat(F.lit("title-only:"), t)).otherwise(F.concat_ws("|", u, t))


def digest(columns: list[Column], separator: str) -> Column:
    """SHA-256 of the values, null as empty."""
    return F.sha2(F.concat_ws(separator, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


#: Parameters whose values are secret.
SECRET_PARAMETERS = ("access_token", "api_key", "apikey", "token", "secret", "password", "client_secret")


def redacted(column: Column) -> Column:
    """What follows a secret parameter's equals sign, the word bearer, or the start of a bot's path, is masked; null counts as empty."""
    named = "|".join(SECRET_PARAMETERS)
    starts = {rf"(?<=[?&](?:{named})=)": r"[^\s&'\"]*", r"(?<=\bbearer\s)\s*": r"[\w.~+/-]+=*", r"(?<=/bot)": r"[\w:-]+"}
    return reduce(lambda c, start: F.regexp_replace(c, f"(?i){start}{starts[start]}", "[REDACTED]"), starts, F.coalesce(column, F.lit("")))


def hashtags(column: Column) -> Column:
    return F.regexp_extract_all(column, F.lit("(#[A-Za-z0-9_]+)"), 1)


def escaped(column: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, column)


def tokens(column: Column) -> Column:
    """The distinct words of over two characters."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(column), "[^a-z0-9 ]", " "), " +"), lambda w: F.length(w) > 2))


def expanded(words: Column, groups: list[list[str]]) -> Column:
    """The words, and all the aliases of a group that holds one of them."""
    empty = F.array().cast("array<string>")
    more = [F.when(F.arrays_overlap(words, F.array(*map(F.lit, g))), F.array(*map(F.lit, g))).otherwise(empty) for g in groups]
    return F.array_distinct(F.concat(words, *more))


def listed_suffix(column: Column, suffixes: list[str]) -> Column:
    """The first of the suffixes, in the order of the list, that the text ends with as a word."""
    return F.coalesce(*[F.when(F.lower(column).endswith(f" {s}"), F.lit(s)) for s in suffixes])


def indian_mobile(column: Column) -> Column:
    """+91 and ten digits; null where the number isn't one."""
    d = F.regexp_replace(F.coalesce(column, F.lit("")), r"[^\d+]", "")
    d = F.when(d.startswith("+91"), F.substring(d, 4, 40)).when(d.startswith("0091"), F.substring(d, 5, 40)).when(d.startswith("91") & (F.length(d) == 12), F.substring(d, 3, 40)).otherwise(d)
    d = F.when(d.startswith("0") & (F.length(d) == 11), F.substring(d, 2, 40)).otherwise(d)
    return F.when(d.rlike("^[0-9]{10}$"), F.concat(F.lit("+91"), d))


def first(column: Column, pattern: str, group: int = 0) -> Column:
    """The first match, null where there is none."""
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit(""))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def email(column: Column) -> Column:
    return F.lower(first(column, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"))


def link(column: Column) -> Column:
    return first(column, r"https?://[^\s)>\]]+")


def listed_words(column: Column, listed: list[str], most: int = 20) -> Column:
    """Words of a list that the text holds between non-letters, in the order of the list."""
    hits = [F.when(F.lower(column).rlike(f"(^|[^a-z0-9]){w}([^a-z0-9]|$)"), F.lit(w)) for w in listed]
    return F.slice(F.array_compact(F.array(*hits)), 1, most)


def first_label(rules: list[tuple[str, str]], column: Column, otherwise: str | None = None) -> Column:
    """The label of the first pattern that the text holds."""
    return F.coalesce(*[F.when(column.rlike(pattern), F.lit(label)) for label, pattern in rules], F.lit(otherwise))


def day_of(column: Column) -> Column:
    """ISO days, and day, month and year with any of / - . between; two digits of a year are of this century; null otherwise."""
    s = F.btrim(column)
    d, m, y = (F.regexp_extract(s, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})$", g) for g in (1, 2, 3))
    parts = F.concat_ws("-", F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(s, "yyyy-MM-dd")).when(d != "", F.try_to_date(parts, "yyyy-MM-dd"))

"""Rows from HTML: anchors, headings and table cells, by built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.fields import field
from tessera.functions.text import clean_text, first
from tessera.operators.tables import held


def anchors(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, pos, href, text of every anchor that leads somewhere; pos counts all anchors of the page from 0."""
    pattern = F.lit(r"""(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>""")
    both = F.arrays_zip(F.regexp_extract_all(html, pattern, 1).alias("href"), F.regexp_extract_all(html, pattern, 2).alias("text"))
    rows = pages.select(key, F.posexplode(both).alias("pos", "a")).select(key, "pos", "a.href", "a.text")
    return rows.where(~F.col("href").rlike("(?i)^(#|javascript:|mailto:|tel:)"))


def elements(pages: DataFrame, key: str, html: str, tag: str) -> DataFrame:
    """key, pos, text of every element of a tag, tags inside removed."""
    found = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>"), 1)
    return pages.select(key, F.posexplode(found).alias("pos", "text")).withColumn("text", F.btrim(F.regexp_replace("text", "<[^>]*>", "")))


def feed_items(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """key, pos, title, link, summary, published of the items and entries that have a title and a link; pos counts all of a feed's from 0."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?is)<(item|entry)\b[^>]*>(.*?)</\1>"), 2)
    rows = feeds.select(key, F.posexplode(blocks).alias("pos", "b"))
    b = F.col("b")
    href = F.nullif(F.btrim(first(b, r"""(?is)<link\b[^>]*\bhref=["']([^"']*)""", 1)), F.lit(""))
    found = rows.select(
        key,
        "pos",
        field(b, ["title"]).alias("title"),
        F.coalesce(field(b, ["link"]), href).alias("link"),
        field(b, ["description", "summary", "content"]).alias("summary"),
        field(b, ["pubDate", "published", "updated", "dc:date"]).alias("published"),
    )
    return found.where("title IS NOT NULL AND link IS NOT NULL")


def table_rows(pages: DataFrame, key: str, html: str, columns: dict[str, str]) -> DataFrame:
    """key, pos, a column for each header pattern and link, the row's first, of the rows under a page's first row of cells.

    A column whose pattern is in no header is null. Rows of several tables count as one table's.
    """
    lines = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)
    cells = lambda c: F.regexp_extract_all(c, F.lit(r"(?is)<t[hd]\b[^>]*>(.*?)</t[hd]>"), 1)
    rows = pages.select(key, cells(F.get(lines, F.lit(0))).alias("_h"), F.posexplode(F.slice(lines, 2, 2**31 - 1)).alias("pos", "_r"))
    rows = rows.withColumn("_c", cells(F.col("_r")))
    place = lambda pattern: F.array_position(F.transform("_h", lambda c: F.regexp_replace(c, "<[^>]*>", "").rlike(f"(?i){pattern}")), True).cast("int")
    named = [clean_text(F.when(place(p) > 0, F.get("_c", place(p) - 1))).alias(name) for name, p in columns.items()]
    return rows.select(key, "pos", *named, first(F.col("_r"), r"""(?i)\bhref=["']([^"']*)""", 1).alias("link"))


#: Keys under which structured data holds further objects.
HOLDERS = ("@graph", "itemListElement", "item", "mainEntity", "hasPart")


def _inner(v: Column) -> Column:
    """What a JSON value holds directly: a list's elements, and those of the holders."""
    inside = [F.coalesce(F.try_variant_get(v, f"$['{k}']", "array<variant>"), F.array(F.try_variant_get(v, f"$['{k}']", "variant"))) for k in HOLDERS]
    listed = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.concat(listed, *inside), lambda x: x.isNotNull())


def structured(pages: DataFrame, key: str, html: str, kind: str, fields: dict[str, str]) -> DataFrame:
    """key and fields (paths by name, as strings) of every object of a type in a page's JSON-LD, however many holders deep.

    A script that is no JSON is read again without comments and commas before a bracket, and skipped if it still is none. Each level of
    holders is a step of its own, until none holds anything.
    """
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script>"""), 1)
    mended = F.regexp_replace(F.regexp_replace("s", r"(?s)/\*.*?\*/", ""), r",\s*([}\]])", "$1")
    level = pages.select(key, F.explode(scripts).alias("s")).select(key, F.coalesce(F.try_parse_json("s"), F.try_parse_json(mended)).alias("v")).where("v IS NOT NULL")
    found = level
    while not (level := held(level.select(key, F.explode(_inner(F.col("v"))).alias("v")))).isEmpty():
        found = found.unionByName(level)
    v = F.col("v")
    named = F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
    return found.where(F.array_contains(named, kind)).select(key, *[F.try_variant_get(v, path, "string").alias(name) for name, path in fields.items()])

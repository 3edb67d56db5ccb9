"""Elements of HTML by position: one pass over a page gives every element's place, depth and holders; all else is joins and windows.

Tags may be in any case, attributes quoted or not, elements nested or never closed.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that end where another of the named ones begins, within the same holder.
ENDS = {"li": ("li",), "tr": ("tr",), "td": ("td", "th", "tr"), "th": ("td", "th", "tr"), "p": ("p", "div", "table", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
HOLDERS = {"li": ("ul", "ol"), "tr": ("table",), "td": ("table",), "th": ("table",), "p": (), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}
#: Elements whose text is given; a text within a text counts for both.
WITH_TEXT = ("a", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "caption", "title", "dt", "dd", "option", "span", "b", "strong")
#: Characters of pages, and rows, that are given on together.
CHARACTERS, ROWS = 1_000_000, 5_000
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

_SCHEMA = "at int, until int, depth int, tag string, attributes map<string,string>, text string, row_at int, table_at int"


class _Reader(HTMLParser):
    """Lists (at, until, depth, tag, attributes, text, row, table) of a page; places count tags and texts from 0."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[list] = []
        self.open: list[list] = []
        self.texts: list[tuple[int, str]] = []
        self.at = 0

    def _holder(self, tag: str) -> int | None:
        return next((e[0] for e in reversed(self.open) if e[3] == tag), None)

    def _close(self, k: int) -> None:
        for element in self.open[k:]:
            element[1] = self.at
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k][3]
            if tag in ENDS.get(name, ()):
                self._close(k)
            elif any(name in HOLDERS[x] for x in HOLDERS if tag in ENDS[x]):
                break
        within = self._holder("table")
        row = next((e[0] for e in reversed(self.open) if e[3] in ("tr", "table")), None)
        element = [self.at, self.at, len(self.open), tag, {k: v or "" for k, v in attrs}, None, row if row != within else None, within]
        self.out.append(element)
        self.at += 1
        if tag not in VOID:
            self.open.append(element)

    def handle_endtag(self, tag: str) -> None:
        k = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][3] == tag), None)
        if k is not None:
            self._close(k)
        self.at += 1

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][3] in ("script", "style")):
            self.texts.append((self.at, data))
        self.at += 1

    def read(self, html: str) -> list[list]:
        self.feed(html)
        self.close()
        self._close(0)
        starts = [a for a, _ in self.texts]
        for e in self.out:
            if e[3] in WITH_TEXT:
                i, j = bisect_left(starts, e[0]), bisect_left(starts, e[1])
                e[5] = " ".join("".join(t for _, t in self.texts[i:j]).split())
        return self.out


def _listed(frames: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """The elements of frames of (key, html). Whole pages are given on together when they, or what was made of them, are some MB."""
    rows: list[tuple] = []
    made = lambda: pd.DataFrame(rows, columns=names).astype({c: "Int64" for c in ("row_at", "table_at")})
    for frame in frames:
        size = 0
        for k, said in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True):
            if said is not None:
                rows += [(k, *e) for e in _Reader().read(said)]
                size += len(said)
                if size >= CHARACTERS or len(rows) >= ROWS:
                    yield made()
                    rows, size = [], 0
        if rows:
            yield made()
            rows = []


def elements(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, at, until, depth, tag, attributes, text, row_at, table_at of every element; null pages have none, keys are unique.

    What is inside an element has places between at and until; row_at and table_at are those of the nearest row and table around it.
    """
    types = {f.name: f.dataType.simpleString() for f in pages.schema}

    names = [key, *[c.split()[0] for c in _SCHEMA.split(", ")]]
    return pages.select(key, html).mapInPandas(lambda frames: _listed(frames, names), f"`{key}` {types[key]}, {_SCHEMA}")


def anchors(found: DataFrame, key: str) -> DataFrame:
    """key, at, href, text of the anchors that lead somewhere."""
    rows = found.where("tag = 'a'").select(key, "at", F.btrim(F.col("attributes")["href"]).alias("href"), "text")
    return rows.where("href <> ''").where(~F.col("href").rlike("(?i)^(#|javascript:|mailto:|tel:)"))


def by_class(found: DataFrame, key: str, tag: str, name: str) -> DataFrame:
    """The elements of a tag that have a class among others; case counts."""
    return found.where((F.col("tag") == tag) & F.array_contains(F.split(F.btrim(F.col("attributes")["class"]), r"\s+"), name))


def within(found: DataFrame, outer: DataFrame, key: str) -> DataFrame:
    """Elements with outer_at, for each of the outer elements that they lie in. Outer ones that lie in each other share what is inside."""
    o = outer.select(F.col(key).alias("_k"), F.col("at").alias("outer_at"), F.col("until").alias("_until"))
    inside = (F.col(key) == F.col("_k")) & (F.col("at") > F.col("outer_at")) & (F.col("at") < F.col("_until"))
    return found.join(o, inside).drop("_k", "_until")


def headed(found: DataFrame, key: str, wanted: Column) -> DataFrame:
    """The wanted elements with heading: the text of the last heading that begins before them on their page, null where there is none."""
    before = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    heading = F.last(F.when(F.col("tag").isin(list(HEADINGS)), F.col("text")), ignorenulls=True).over(before)
    few = found.where(F.col("tag").isin(list(HEADINGS)) | wanted)
    return few.withColumn("heading", heading).where(wanted)


def table_rows(found: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """key, table_at, row_at, a column for each header pattern, links (by those names), of the rows under each table's own header.

    The header is a table's first row with cells. Cells of a table within a cell are that table's. A pattern that no header cell of a
    table holds gives null there; tables none of whose headers fits have no rows.
    """
    cells = found.where("tag IN ('td', 'th') AND row_at IS NOT NULL")
    links = anchors(found, key).select(key, F.col("at").alias("a_at"), "href")
    place = F.row_number().over(Window.partitionBy(key, "row_at").orderBy("at"))
    first_row = F.min("row_at").over(Window.partitionBy(key, "table_at"))
    cells = cells.select(key, "table_at", "row_at", "at", "until", F.coalesce("text", F.lit("")).alias("text"), place.alias("place"), first_row.alias("head_at"))
    heads = cells.where("row_at = head_at")
    named = heads.select(key, "table_at", "place", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col("text").rlike(f"(?i){p}").alias("fits")) for n, p in columns.items()])))
    named = named.where("fits").groupBy(key, "table_at", "name").agg(F.min("place").alias("place"))
    rest = cells.where("row_at > head_at").join(named, [key, "table_at", "place"])
    linked = rest.join(links.withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & F.col("a_at").between(F.col("at"), F.col("until")), "left")
    each = linked.groupBy(key, "table_at", "row_at", "name", "text").agg(F.min(F.struct("a_at", "href")).alias("l"))
    by = lambda c, n: F.max(F.when(F.col("name") == n, c))
    return each.groupBy(key, "table_at", "row_at").agg(*[by(F.col("text"), n).alias(n) for n in columns], F.map_from_entries(F.collect_list(F.when(F.col("l.href").isNotNull(), F.struct("name", "l.href")))).alias("links"))

"""Elements by position: quotes and cases of attributes, nested and unclosed elements, tables under headings, structured data at any depth."""

import json

import pandas as pd
from pyspark.sql import functions as F

from tessera.sources import elements as E
from tessera.sources import markup


def _found(spark, *pages):
    return E.elements(spark.createDataFrame(list(enumerate(pages)), "id long, html string"), "id", "html")


def _rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_anchors(spark):
    page = """<A HREF=/z>Z</A> <a href='/x'>one <b>two</b></a> <a class=k href="/q?a=1&amp;b=2">q</a> <a href="#top">t</a><a name=n>no</a><a href=" ">e</a><a href="mailto:a@b.c">m</a>
    <!-- <a href="/c">comment</a> --><script>'<a href="/s">s</a>'</script><a href=/open>open"""
    found = _found(spark, page, None, "", "no tags < at & all", "<<a href=/odd>odd</a >")
    assert _rows(E.anchors(found, "id"), "id", "href", "text") == [(0, "/open", "open"), (0, "/q?a=1&b=2", "q"), (0, "/x", "one two"), (0, "/z", "Z"), (4, "/odd", "odd")]


TABLES = """
<h2>Open posts</h2>
<table><tr><th>Post<th>No.<tr><td>AE<td>5<tr><td>JE <table><tr><th>Post</th></tr><tr><td>inner</td></tr></table></td><td><a href=/je>3</a> <a href=/other>x</a></td></tr></table>
<div><h3>Results &amp; lists</h3><p>text<p>more</div>
<table><tbody><tr><td>No</td><td>Name of post</td></tr><tr><td>7</td><td><a href='/clerk'>Clerk</a></td></tr><tr><td>8</td></tr></tbody></table>
<table><tr><td>nothing here</td></tr><tr><td>x</td></tr></table>
"""


def test_tables_with_their_own_headers(spark):
    found = _found(spark, TABLES)
    rows = E.table_rows(found, "id", {"post": r"\bpost\b", "number": r"^no\b"})
    assert sorted(((r["post"], r["number"], r["links"]) for r in rows.collect()), key=repr) == sorted(
        [("AE", "5", {}), ("JE Postinner", "3 x", {"number": "/je"}), ("inner", None, {}), ("Clerk", "7", {"post": "/clerk"}), (None, "8", {})], key=repr
    )
    tables = E.headed(found, "id", F.col("tag") == "table")
    assert [r["heading"] for r in tables.orderBy("at").collect()] == ["Open posts", "Open posts", "Results & lists", "Results & lists"]
    assert _rows(E.headed(found, "id", F.col("tag") == "p"), "text", "heading") == [("more", "Results & lists"), ("text", "Results & lists")]


def test_classes_and_holders(spark):
    page = '<p>before</p><div class="card new"><span>a</span><div class=card><span>b</span></div></div><div class="cards"><span>c</span></div><ul><li>1<ul><li>2</ul><li>3</ul>'
    found = _found(spark, page)
    cards = E.by_class(found, "id", "div", "card")
    assert _rows(cards, "depth") == [(0,), (1,)]
    inside = E.within(found.where("tag = 'span'"), cards, "id")
    assert sorted(r["text"] for r in inside.collect()) == ["a", "b", "b"]
    assert _rows(found.where("tag = 'li'"), "depth", "text") == [(1, "12"), (1, "3"), (3, "2")]
    assert E.headed(found, "id", F.col("tag") == "p").first()["heading"] is None


def test_structured_at_any_depth(spark):
    deep = {"@type": "JobPosting", "title": "deep"}
    for name in ("item", "mainEntity", "hasPart", "@graph", "itemListElement", "item"):
        deep = {name: [deep, 1, None]}
    many = {"@graph": [{"@type": ["X", "JobPosting"], "title": f"t{i}"} for i in range(10_000)]}
    pages = [f'<script type="application/ld+json">{json.dumps(x)}</script>' for x in (deep, many)] + ["<script type='application/ld+json'>{no</script>", None]
    got = markup.structured(spark.createDataFrame(list(enumerate(pages)), "id long, html string"), "id", "html", "JobPosting", {"title": "$.title"})
    assert {r["id"]: r["count"] for r in got.groupBy("id").count().collect()} == {0: 1, 1: 10_000}
    assert got.where("id = 0").first()["title"] == "deep"


def test_empty(spark):
    found = _found(spark, None)
    assert found.collect() == [] and E.table_rows(found, "id", {"a": "a"}).collect() == [] and E.anchors(found, "id").collect() == []


def test_pages_are_read_in_parts():
    """However many pages come at once, what is made of them is given on every few thousand rows."""
    pages = pd.DataFrame({"id": range(4000), "html": ["<p>a<p>b<ul><li>c</ul>"] * 3999 + [None]})
    names = ["id", *[c.split()[0] for c in E._SCHEMA.split(", ")]]
    parts = list(E._listed(iter([pages, pages.head(2)]), names))
    assert sum(map(len, parts)) == 4 * (3999 + 2) and max(map(len, parts)) < E.ROWS + 4
    assert [len(p) for p in E._listed(iter([pages.tail(1)]), names)] == []

"""Titles, posts, searches, links and matches on nulls, empty texts, ties and values stated by hand."""

from pyspark.sql import functions as F

from tessera.functions import fields as D
from tessera.functions import titles as T
from tessera.operators import scores, sinks
from tessera.operators import verdicts as V
from tessera.sources import links as L


def _one(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_titles_without_text(spark):
    assert [tuple(r) for r in _one(spark, T.title_verdict, [None, "", " \n", "--"])] == [("junk", "no title", "")] * 3 + [("junk", "text of a link", "")]
    assert _one(spark, T.posts, [None, "", " \n "]) == [[], [], []]
    assert _one(spark, lambda c: T.link_title(c, c), [None, "Apply", "x"]) == ["", "Apply", "x"]
    assert [r["confident"] for r in _one(spark, lambda c: T.search(c, {"A": ["a b"]}, ["Pune"], ["Goa"]), [None, "", "pune"])] == [False, False, True]
    assert [tuple(r) for r in _one(spark, lambda c: T.role_and_company(c, c), [None, "", "X at Yz"])] == [(None, None), ("", None), ("X", "Yz")]


def test_many_posts(spark):
    lines = [f"Site Engineer {chr(97 + i)}{chr(97 + j)}" for i in range(5) for j in range(8)]
    found = _one(spark, T.posts, ["\n".join(lines)])[0]
    assert [r["title"] for r in found] == lines[:25]
    assert found[0]["block"] == lines[0] and found[24]["block"] == "\n".join(lines[24:])


def test_lines_that_are_no_posts(spark):
    lines = ["Skills: planning", "ABC Infrastructure Pvt. Ltd.", "We are looking for an engineer", "Engineer.", "Salary", "AutoCAD", "x" * 60 + " engineer", "Site Engineer – 20-25k"]
    assert _one(spark, T.post_line, lines) == [None] * 7 + ["Site Engineer"]


def test_frames_and_capitals(spark):
    said = ["Notice for recruitment", "For the vacancies of: Surveyor (Roads)", "Press Release - notification regarding the post of Clerk", "Notice board keeper", "Engineer on notice", "To the Director", "the post of Clerk"]
    said += ["Clerk through direct recruitment", "Clerk grade II through walk-in, on contract basis.", "Clerk under Mode", "Works: Planner -"]
    want = ["Notice for recruitment", "Surveyor (Roads)", "Clerk", "Notice board keeper", "Engineer on notice", "To the Director", "the post of Clerk"]
    want += ["Clerk through direct recruitment", "Clerk grade II through walk-in", "Clerk under Mode", "Works: Planner"]
    assert _one(spark, T.cleaned_title, said) == want
    assert _one(spark, T.post_line, ["SITE ENGINEER", "* QA/QC Engineer (Rs. 30,000 per month)", "CAD", "2) Geotechnical expert", "Location: engineer"]) == ["Site Engineer", "QA/QC Engineer", "CAD", "Geotechnical expert", None]


def test_absolute(spark):
    rows = [("https://a.b/c/d?e=/f", u) for u in ("x", "/x", "//y/z", "http://q", "#a", "", "tel:5", None)] + [("https://a.b", "x")]
    df = spark.createDataFrame(rows, "base string, u string")
    assert [r[0] for r in df.select(L.absolute(F.col("u"), F.col("base"))).collect()] == ["https://a.b/c/x", "https://a.b/x", "https://y/z", "http://q", None, None, None, None, "https://a.b/x"]


def test_feeds_without_keys():
    assert L.keyed({"a": (None, lambda _: 1 / 0), "b": ("", lambda _: 1 / 0)}, ["id"]) is None


def test_verdicts_on_nulls(spark):
    df = spark.createDataFrame([(None, None)], "t string, b boolean")
    t, b = F.col("t"), F.col("b")
    made = [
        V.role_accepted(t, t, ["a"], ["b"], ["c"], ["d"])["reason"],
        V.level(t, b, ["a"], ["b"], ["c"], b),
        V.by_hits(t, ["a"], ["b"])["tier"],
        V.selected(t, t, t, b, b, "a", ["b"], ["c"])["evidence"],
        V.course(t, t, b, ["a"], ["b"], [("c", b)], t, t, ["d"])["reason"],
    ]
    assert list(df.select(*[c.alias(str(i)) for i, c in enumerate(made)]).first()) == ["no such role", "none", "U", "section", "no text"]


def test_scores_on_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None)], "s string, a array<string>, n int, b boolean")
    s, a, n, b = map(F.col, df.columns)
    wants = {"roles": a, "skills": a, "places": a, "least_years": n, "most_years": n, "least_pay": n, "sector": s}
    has = {"title": s, "text": s, "place": s, "years": n, "pay": n, "sector": s}
    open_role = wants | {"roles": F.array(F.lit("x"))}
    made = [scores.facet_score([b, b]), scores.preference_score(wants, has), scores.preference_score(open_role, has), scores.profile_score(s, s, a, b, s, s, b, b, b), scores.alerted(s, a, a, s, s)]
    assert list(df.select(*[c.alias(str(i)) for i, c in enumerate(made)]).first()) == [40, None, 75, 15, True]


def test_batches_resume(spark):
    items = spark.range(10).withColumnRenamed("id", "k")
    done = spark.createDataFrame([], "k long")
    seen = []
    while rows := sinks.next_batch(items, done, "k", 4).collect():
        seen += [r.k for r in rows]
        done = spark.createDataFrame([(k,) for k in seen], "k long")
    assert seen == list(range(10))
    assert sinks.numbered_pages(items.limit(0), "k").count() == 0


def test_postings_without_fields(spark):
    said = [None, "", "[]", "{}", '{"value": null}', '["Pune"]']
    assert [tuple(r) for r in _one(spark, D.posted_place, said)] == [(None,) * 4, (None, None, None, "")] + [(None,) * 4] * 3 + [(None, None, None, "Pune")]
    assert _one(spark, D.posted_pay, said) == [None] * 6

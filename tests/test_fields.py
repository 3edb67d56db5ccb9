"""Fields, verdicts and sources on nulls, empty texts and values stated by hand."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import fields as D
from tessera.operators import sinks
from tessera.operators import verdicts as V
from tessera.sources import markup, records


def _one(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v"))).collect()]


def test_salary(spark):
    said = [None, "", "Salary: 3 - 5 LPA", "€ 2,500", "2 years, $50k per year", "CTC 12 lakhs", "Pay ₹ 20,000.50"]
    found = [tuple(r) for r in _one(spark, D.salary, said)]
    nothing = (None,) * 4
    assert found == [nothing, nothing, (300000.0, 500000.0, "INR", "year"), (2500.0, None, "EUR", None), (50000.0, None, "USD", "year"), (1200000.0, None, "INR", "year"), (20000.5, None, "INR", None)]


def test_nothing_said(spark):
    for f in (D.degree, D.notice_number, D.video_id, lambda c: D.location(c, {"Pune": "Maharashtra"}), lambda c: D.company(c, c), D.canonical_json):
        for r in _one(spark, f, [None, "", " \n"]):
            assert r is None or not any(r)
    assert [tuple(r) for r in _one(spark, D.deadline, [None, ""])] == [("fixed", None, None)] * 2
    assert _one(spark, D.paragraphs, [None, "", " \n ", "a\n b"]) == [None, [], [], ["a b"]]
    assert [tuple(r) for r in _one(spark, lambda c: D.command(c, ["jobs?"]), [None, "", "Jobs", "job  in x"])] == [("help", None, ""), ("help", None, ""), ("jobs", None, ""), ("job", None, "in x")]


def test_paragraphs(spark):
    words = [str(i) for i in range(601)]
    assert _one(spark, D.paragraphs, [" \t".join(words)]) == [[" ".join(words[i : i + 300]) for i in (0, 300, 600)]]


def test_ages(spark):
    df = spark.createDataFrame([(x,) for x in (None, -5, 59, 60, 3599, 86_399, 29 * 86_400, 364 * 86_400, 365 * 86_400)], "v bigint")
    found = df.select(D.short_age(F.col("v")), D.age_class(F.col("v"))).collect()
    assert [r[1] for r in found] == ["", "old", "fresh", "fresh", "fresh", "fresh", "old", "old", "old"]
    assert [r[0] for r in found[1:]] == ["just now", "just now", "1m ago", "59m ago", "23h ago", "29d ago", "0y ago", "1y ago"]


def test_resolved(spark):
    values = spark.sql("SELECT array(named_struct('value', 'a', 'official', false, 'confidence', 0.5D), named_struct('value', 'b', 'official', true, 'confidence', 0.5D), named_struct('value', 'c', 'official', true, 'confidence', null)) AS v UNION ALL SELECT array()")
    for how, want in (("official", ["b", None]), ("highest", ["a", None]), ("manual", ["m", "m"])):
        assert [r[0] for r in values.select(D.resolved(F.col("v"), F.lit(how), F.lit("m"))).collect()] == want


@pytest.mark.parametrize("html", [None, "", "<table></table>", "<tr><th>Post</th></tr>", "<rss>", '<script type="application/ld+json">null</script>'])
def test_no_rows(spark, html):
    pages = spark.createDataFrame([(1, html)], "id int, html string")
    assert markup.feed_items(pages, "id", "html").count() == 0
    assert markup.table_rows(pages, "id", "html", {"post": "post"}).count() == 0
    assert markup.structured(pages, "id", "html", "JobPosting", {"title": "$.title"}).count() == 0


def test_robots_without_text(spark):
    sites = spark.createDataFrame([(1, None), (2, ""), (3, "User-agent: *\nDisallow: /(a)[+]")], "id int, text string")
    links = spark.createDataFrame([(1, "x", "/"), (2, "y", "/"), (3, "z", "/(a)[+]/b"), (3, "w", "/a"), (4, "v", None)], "id int, link string, path string")
    found = V.allowed(links, V.robots_rules(sites, "id", "text", "bot"), "id", "link", F.col("path")).collect()
    assert {r.link: r.allowed for r in found} == {"x": True, "y": True, "z": False, "w": True, "v": True}


def test_stacked_and_reviewed(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n")], "id int, a string")
    b = spark.createDataFrame([(1, "y"), (2, "z"), (None, "m")], "id int, b string")
    assert {tuple(r) for r in records.stacked(a, b, "id").collect()} == {(1, "x", None), (None, "n", None), (2, None, "z"), (None, None, "m")}
    assert records.stacked(None, b, "id").count() == 3
    old = spark.createDataFrame([(1, "p", "gov/1"), (2, None, None)], "id int, v string, link string")
    new = spark.createDataFrame([(1, "", "com/1"), (3, "q", "com/3")], "id int, v string, link string")
    got = sinks.reviewed(old, new, "id", "link", F.col("link").startswith("gov")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, "p", "gov/1"), (2, None, None), (3, "q", "com/3")]

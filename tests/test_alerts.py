"""Alerts by inverted index, and sliding horizons, against brute force."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from tessera.operators import alerts
from tessera.operators.horizons import sliding

ALERTS = "id long, kind string, keywords array<string>, fields array<string>"


def _wants(alert, text):
    _, _, keywords, fields = alert
    hay = (text or "").lower()
    asked = lambda words: [w.strip().lower() for w in words or [] if w and w.strip()]
    return (not asked(keywords) or any(k in hay for k in asked(keywords))) and all(f in hay for f in asked(fields))


def _lets(kind, sector):
    public = any(x in (sector or "").lower() for x in ("government", "public sector"))
    return {"private": not public, "government": public}.get(kind, True)


def _found(spark, made, listed):
    left, right = spark.createDataFrame(made, ALERTS), spark.createDataFrame(listed, "job long, text string, sector string, _alert string")
    got = alerts.matches(left, right.drop("_alert"), "id", "job", "text", alerts.sector_gate(F.col("kind"), F.col("sector")))
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    return sorted(map(tuple, got.collect()))


def test_many_alerts(spark, monkeypatch):
    """10 000 alerts that share a keyword, with few parts allowed: the shared piece is split, and each pair is found once."""
    monkeypatch.setattr(alerts, "MEET", 2000)
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdef", k=rnd.randint(1, 7))) for _ in range(300)]
    listed = [(j, " ".join(rnd.choices(words, k=12)) + (" engineer" if j % 10 == 0 else ""), ["Government", "Private", None][j % 3], "") for j in range(60)]
    made = [(i, ["all", "private", "government", "odd"][i % 4], ["Engineer", rnd.choice(words)] if i % 3 else ["engineer"], [rnd.choice(words)] if i % 2 else []) for i in range(10_000)]
    wanted = sorted((a[0], j[0]) for a in made for j in listed if _lets(a[1], j[2]) and _wants(a, j[1]))
    assert len(wanted) > 10_000
    assert _found(spark, made, listed) == wanted


def test_edges(spark):
    made = [
        (1, "all", None, None), (2, "all", [], ["", " "]), (3, "private", ["ÄÖ"], None), (4, "all", ["x"], ["yz"]), (5, "all", ["ab"], None), (6, "all", ["abcabc", "abca"], ["abc"]),
        (7, "all", ["a%b_c\\"], None), (8, None, ["nowhere"], None), (9, "all", [None, "line\nbreak"], None),
    ]
    listed = [(1, None, None, ""), (2, "", "Government", ""), (3, "äö X yz", "private", ""), (4, "abcabc ABCA", "public sector", ""), (5, "A%B_C\\ line\nbreak", "x", ""), (6, "abcabc ABCA", "public sector", "")]
    assert _found(spark, made, listed) == sorted((a[0], j[0]) for a in made for j in listed if _lets(a[1], j[2]) and _wants(a, j[1]))
    assert _found(spark, [], listed) == [] and _found(spark, made, []) == []


def test_sliding(spark):
    rnd = random.Random(2)
    start = date(2024, 1, 1)
    rows = [(rnd.choice([1, 2, 3, 4, 5, None]), start + timedelta(days=rnd.choice([0, 1, 2, 5, 9, 20, 33]))) for _ in range(80)] + [(1, None)]
    got = sliding(spark.createDataFrame(rows, "u long, d date"), F.col("d"), "u", [1, 2, 7, 30], F.lit("2024-02-20").cast("date"))
    for day, horizon, n, keys in map(tuple, got.collect()):
        inside = [u for u, d in rows if d and day - timedelta(days=horizon) < d <= day]
        assert (n, keys) == (len(inside), len({u for u in inside if u is not None}))
    assert got.count() == 4 * 51


def test_shown_terms(spark):
    """The terms that stand in a text, whole and each once, whatever their size and however alike their ends; none goes over two texts."""
    rnd = random.Random(3)
    texts = ["".join(rnd.choices("abä\n", k=rnd.randint(0, 60))) for _ in range(200)] + ["", "x" * 8 + "midmid" + "y" * 8 + "z" + "x" * 8 + "dimdim" + "y" * 8, "abab" * 100]
    asked = {t[i : i + n] for t in texts[:40] for i, n in [(rnd.randint(0, 30), rnd.randint(1, 25))]} - {""} | {"x" * 8 + "midmid" + "y" * 8, "x" * 8 + "nomid " + "y" * 8, "x" * 8 + "dimdim" + "y" * 8, "abababab", "ababababa"}
    words = spark.createDataFrame(list(enumerate(sorted(asked))), "_term long, term string").select(F.col("term").cast("binary").alias("raw"), "_term")
    listed = spark.createDataFrame(list(enumerate(texts)), "_listing long, text string").select("_listing", F.col("text").cast("binary").alias("raw"))
    got = sorted(map(tuple, alerts.shown_terms(listed, words).select("_listing", "_term").collect()))
    assert got == sorted((i, k) for i, t in enumerate(texts) for k, x in enumerate(sorted(asked)) if x in t)

"""Fuzzy duplicates and related listings against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import duplicates as D

FIELDS = list(D.WEIGHTS)


def _normal(v):
    return " ".join(re.findall(r"[^\W_]+", (v or "").lower())) or None


def _record(row):
    out = {f: _normal(v) for f, v in zip(FIELDS, row[1:], strict=True)}
    out |= {f: {w for w in (out[f] or "").split() if len(w) > 2} for f in D.SIMILAR}
    return out | {"phone": re.sub(r"\D", "", row[1 + FIELDS.index("phone")] or "") or None, "url": row[1 + FIELDS.index("url")] or None}


def _cents(a, b):
    total = 0
    for f, w in D.WEIGHTS.items():
        if f in D.SIMILAR:
            total += w * bool(a[f] and b[f] and len(a[f] & b[f]) * 100 >= D.SIMILAR[f] * len(a[f] | b[f]))
        else:
            total += w * (a[f] is not None and a[f] == b[f])
    return min(total, 100)


def _brute(rows, most):
    records = [(r[0], _record(r)) for r in rows]
    out = []
    for i, a in records:
        found = sorted((-_cents(a, b), j) for j, b in records if j != i)
        out += [(i, j, -c / 100) for c, j in found[:most] if -c >= D.NEED]
    return sorted(out)


def _rows():
    rnd = random.Random(7)
    words = ["site", "civil", "road", "bridge", "junior", "senior", "planner", "welder", "to", "the", "quantity", "survey"]
    some = lambda values, empty=0.3: None if rnd.random() < empty else rnd.choice(values)
    rows = []
    for i in range(220):
        title, text = " ".join(rnd.sample(words, rnd.randint(1, 4))), " ".join(rnd.choices(words, k=rnd.randint(0, 9)))
        rows.append((i, some(["A@x.org", "a@X.org ", "b@y.in"]), some(["+91 98-1", "9198 1", "77"]), some(["u1", "u2", ""]), some(["Acme Ltd.", "acme ltd", "Bee"], 0.1), title, some(["Pune", "PUNE", "Goa"]), text))
    rows += [(1000 + i, None, "", " ", "", None, "", "") for i in range(3)]
    rows += [(2000 + i, "c@c.c", "5", "u9", "Cee", "copied title words", "Agra", "same text in every copy") for i in range(300)]
    return rows


@pytest.mark.parametrize(("most", "meet"), [(1, 500_000), (25, 300)])
def test_fuzzy(spark, monkeypatch, most, meet):
    """Copies of one posting, blocks split over parts, and blanks that match nothing."""
    monkeypatch.setattr(D, "MEET", meet)
    rows = _rows()
    frame = spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} string" for f in FIELDS)).withColumn("_key", F.lit(1))
    got = D.fuzzy_duplicates(frame, "id", {f: F.col(f) for f in FIELDS}, most)
    found = [tuple(r) for r in got.select("id", "other", "score").collect()]
    assert sorted(found) == _brute(rows, most)
    assert "Cartesian" not in got._jdf.queryExecution().toString() and "NestedLoop" not in got._jdf.queryExecution().toString()
    said = got.where("id = 2000").select("reasons").first()[0]
    assert said == ["same email", "same phone", "same url", "same company", "similar title", "same city", "description overlap 100%"]


def test_empty(spark):
    frame = spark.createDataFrame([], "id long, " + ", ".join(f"{f} string" for f in FIELDS))
    assert D.fuzzy_duplicates(frame, "id", {f: F.col(f) for f in FIELDS}).collect() == []


def test_minimal_sets():
    found = D.minimal_sets(D.WEIGHTS, D.NEED)
    assert ("title", "city", "description") in found and ("email", "city") not in found and ("company", "title") in found
    assert all(sum(D.WEIGHTS[x] for x in c) >= D.NEED for c in found)


def test_equal_fields_need_no_pairs(spark, monkeypatch):
    """Postings with equal fields and texts of their own: not every one meets every other, and the best ones are those of all pairs."""
    met, meetings = [], D._meetings
    monkeypatch.setattr(D, "_meetings", lambda *a: met.append(meetings(*a)) or met[-1])
    rows = [(i, "a@x.org", str(i % 2), "u1", "Acme", f"planner of works {i % 3}", "Pune", f"site road bridge number{i}") for i in range(150)]
    frame = spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} string" for f in FIELDS))
    found = D.fuzzy_duplicates(frame, "id", {f: F.col(f) for f in FIELDS}, 1).select("id", "other", "score").collect()
    assert sorted(tuple(r) for r in found) == _brute(rows, 1)
    assert met[0].count() < 10 * len(rows)

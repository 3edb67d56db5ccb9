"""Related listings of all listings against all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import related as R


def _normal(v):
    return " ".join(re.findall(r"[^\W_]+", (v or "").lower()))


def _brute(rows, most):
    out = []
    for i, title, skills, text, place, sector, _ in rows:
        found = []
        for j, title2, _, text2, place2, sector2, featured in rows:
            if i == j:
                continue
            shares = lambda a, b: any(len(w) > 3 and w in _normal(b) for w in _normal(a).split())
            score = 35 * shares(title, title2) + 20 * shares(place, place2) + 8 * (sector is not None and sector == sector2) + 2 * bool(featured)
            score += min(30, 10 * sum(s in _normal(text2) for s in {_normal(s) for s in skills or []} - {""}))
            if score >= 25:
                found.append((-score, j))
        out += [(i, j, -s) for s, j in sorted(found)[:most]]
    return sorted(out)


@pytest.mark.parametrize(("most", "meet"), [(4, 500_000), (2, 40)])
def test_related(spark, monkeypatch, most, meet):
    """Copies, words within words, nulls, and postings split over parts."""
    monkeypatch.setattr(R, "MEET", meet)
    rnd = random.Random(3)
    words, skills = ["Site", "sites", "Engineer", "engineering", "civil", "road", "a", "Planner"], ["AutoCAD", "ms project", "BIM", "", "road"]
    rows = []
    for i in range(90):
        some = lambda values: None if rnd.random() < 0.2 else rnd.choice(values)
        text = " ".join(rnd.choices(["autocad", "MS-Project", "bim", "roads", "none"], k=rnd.randint(0, 4)))
        rows.append((i, " ".join(rnd.choices(words, k=2)), rnd.sample(skills, 3) if i % 5 else None, text, some(["Pune", "Navi Mumbai", "Puneri"]), some(["A", "B"]), some([True, False])))
    rows += [(200 + i, "Same Surveyor", ["bim", "autocad"], "bim autocad", "Agra", "C", True) for i in range(40)] + [(300, None, None, None, None, None, None), (301, "", [], "", "", "", None)]
    frame = spark.createDataFrame(rows, "id long, title string, skills array<string>, text string, place string, sector string, featured boolean")
    c = F.col
    got = R.related(frame, "id", c("title"), c("skills"), c("text"), c("place"), c("sector"), c("featured"), most)
    assert sorted(map(tuple, got.collect())) == _brute(rows, most)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert R.related(frame.where("false"), "id", c("title"), c("skills"), c("text"), c("place"), c("sector"), c("featured")).collect() == []


def _most_rows(plan):
    """The most rows that any step of a plan gave out."""
    kind, below = plan.getClass().getSimpleName(), []
    if kind == "AdaptiveSparkPlanExec":
        below = [plan.executedPlan()]
    elif kind.endswith("QueryStageExec"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().get("numOutputRows")
    return max([own.get().value() if own.isDefined() else 0, *map(_most_rows, below)])


def test_no_pairs(spark):
    """600 listings that differ and share a word of the title: none of the steps lists their 360 000 pairs."""
    rows = [(i, f"Common surveyor{i}", [f"skill{i}"], f"skill{i}", f"Place{i}", None, False) for i in range(600)]
    frame = spark.createDataFrame(rows, "id long, title string, skills array<string>, text string, place string, sector string, featured boolean")
    c = F.col
    got = R.related(frame, "id", c("title"), c("skills"), c("text"), c("place"), c("sector"), c("featured"), 2)
    found = {}
    for a, b, _ in got.collect():
        found.setdefault(a, []).append(b)
    assert all(len(found[i]) == 2 for i in range(600))
    assert _most_rows(got._jdf.queryExecution().executedPlan()) < 50 * len(rows)

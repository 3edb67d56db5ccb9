"""Terms of a table in texts against brute force, and the trade's vocabularies."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.operators import dictionary as D


def _words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def _brute(text, terms):
    words, spans = _words(text), set()
    for term, _ in terms:
        t = _words(term)
        spans |= {(p, p + len(t)) for p in range(len(words) - len(t) + 1) if t and words[p : p + len(t)] == t}
    kept = [s for s in spans if not any(o != s and o[0] <= s[0] and s[1] <= o[1] for o in spans)]
    return sorted((p, q - p, " ".join(words[p:q])) for p, q in kept)


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_thousand_terms(spark, broadcast):
    """The plan is as large for a thousand terms as for one, whether or not Spark broadcasts them."""
    rnd = random.Random(4)
    letters = ["".join(rnd.choices("abcdé", k=rnd.randint(1, 2))) for _ in range(40)]
    terms = [(rnd.choice([" ", "-", "  "]).join(rnd.choices(letters, k=rnd.randint(1, 4))).title(), f"label{i % 7}") for i in range(1000)] + [("", "x"), ("!", "x"), (None, "x")]
    texts = [(i, " ".join(rnd.choices([*letters, "zz", ","], k=rnd.randint(0, 80)))) for i in range(60)] + [(100, None), (101, ""), (102, "no such thing"), (103, " ".join(letters * 60))]
    frame, table = spark.createDataFrame(texts, "id long, said string").withColumn("place", F.lit(9)), spark.createDataFrame(terms, "term string, label string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = D.hits(frame, "id", "said", table)
        got = {}
        for r in found.collect():
            got.setdefault(r["id"], []).append((r["place"], r["n"], r["term"]))
            assert r["labels"] == sorted({label for t, label in terms if " ".join(_words(t)) == r["term"]})
        size = lambda x: len(x._jdf.queryExecution().analyzed().toString())
        few = D.hits(frame, "id", "said", spark.createDataFrame(terms[:1], "term string, label string"))
        assert size(found) < 1.3 * size(few)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {i: sorted(x) for i, x in got.items()} == {i: b for i, t in texts if (b := _brute(t, [x for x in terms if x[0]]))}
    assert D.labelled(frame, "id", found).count() == len(texts)


def test_no_terms(spark):
    texts = spark.createDataFrame([(1, "a b")], "id long, said string")
    none = spark.createDataFrame([], "term string, label string")
    found = D.hits(texts, "id", "said", none)
    assert found.collect() == []
    rules = spark.createDataFrame([], "rank int, needs array<string>, bars array<string>, verdict string")
    assert [tuple(r) for r in D.ruled(D.labelled(texts, "id", found), "id", rules, "none").collect()] == [(1, "none", None)]


SECTORS = [
    ("Junior engineer, Public Works Department", "Government"), ("Site engineer, PWD road, Acme Pvt. Ltd", "Private"), ("Metro Rail, staffing by XY", "Private"), ("Development Authority of Pune", "Government"),
    ("Department: projects", "Private"), ("ministry of roads", "Government"), ("apply at www.cpwd.gov.in", "Government"), (None, "Private"), ("governmental", "Private"), ("Walk-in at site", "Private"), ("UPSC 2024", "Government"),
]


def test_sector(spark):
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SECTORS)], "id long, said string")
    found = D.hits(texts, "id", "said", V.terms(spark, {"private": V.PRIVATE, "public": V.PUBLIC}))
    got = {r["id"]: r["verdict"] for r in D.ruled(D.labelled(texts, "id", found), "id", V.sector_rules(spark), "Private").collect()}
    assert got == {i: s for i, (_, s) in enumerate(SECTORS)}


def test_places_types_and_modes(spark):
    said = ["Site engineer in Greater Noida, on-site", "New Delhi or Navi Mumbai; full time, hybrid or WFH", "Rajkot contract work", "Agra temp", "nowhere", None, "contractor international remotely"]
    texts = spark.createDataFrame(list(enumerate(said)), "id long, said string")
    places = D.hits(texts, "id", "said", V.terms(spark, V.CITIES))
    assert {(r["id"], r["term"], r["labels"][0]) for r in places.collect()} == {(0, "greater noida", "Uttar Pradesh"), (1, "new delhi", "Delhi"), (1, "navi", "Maharashtra"), (1, "mumbai", "Maharashtra"), (2, "rajkot", "Gujarat"), (3, "agra", "Uttar Pradesh")}
    first = lambda words: {r["id"]: r["verdict"] for r in D.ruled(D.labelled(texts, "id", D.hits(texts, "id", "said", V.terms(spark, words))), "id", V.first_label(spark, words), "-").collect()}
    assert first(V.JOB_TYPES) == {0: "-", 1: "Full-time", 2: "Contract", 3: "Temporary", 4: "-", 5: "-", 6: "-"}
    assert first(V.WORK_MODES) == {0: "On-site", 1: "Remote", 2: "-", 3: "-", 4: "-", 5: "-", 6: "-"}
    assert {r["term"] for r in D.hits(spark.createDataFrame([(1, "QA/QC civil with AutoCAD and Civil-3D, safe")], "id long, said string"), "id", "said", V.terms(spark, {"skill": V.SKILLS})).collect()} == {"qa qc civil", "autocad", "civil 3d", "safe"}

"""Queries of ordered verdicts, robots rules and scores of a listing for a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import fields as D
from tessera.functions.text import first_label
from tessera.operators import scores
from tessera.operators import verdicts as V
from tessera.plans.fields import _said
from tessera.plans.registry import Tables, query

_HOME, _AWAY = ["pune", "chennai", "tamil nadu"], ["france", "germany", "dubai"]


@query("e14_country_status", """
SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'home' WHEN 1 THEN 'foreign' WHEN 2 THEN 'home' WHEN 3 THEN 'foreign' WHEN 4 THEN 'unknown' ELSE 'home' END AS status FROM customer""")  # fmt: skip
def e14(t: Tables) -> DataFrame:
    country = _said("c_custkey", 6, "India", "France", "", "", "", "")
    place = _said("c_custkey", 6, "Dubai", "Pune {c_custkey}", "near Tamil Nadu, not Dubai", "Dubai {c_custkey}", "Punes", "all India and France")
    return t.customer.select("c_custkey", V.country_status(F.nullif(country, F.lit("")), place, "india", _HOME, _AWAY).alias("status"))


@query("c03_eligibility", """
SELECT c_custkey, c_custkey % 6 IN (1, 2, 4) AS eligible, CASE c_custkey % 6 WHEN 0 THEN 'foreign location' WHEN 1 THEN 'evidence' WHEN 2 THEN 'evidence' WHEN 3 THEN 'work abroad' WHEN 4 THEN 'trusted source' ELSE 'no evidence' END AS reason FROM customer""")  # fmt: skip
def c03(t: Tables) -> DataFrame:
    country = F.when(F.col("c_custkey") % 6 == 0, "France")
    place = _said("c_custkey", 6, "Pune", "Pune, {c_custkey}", "", "", "", "")
    body = _said("c_custkey", 6, "in pune", "for France", "work in Chennai", "Gulf project {c_name}", "{c_name}", "{c_name}, clients in France")
    source = F.when(F.col("c_custkey") % 6 == 4, "TrustedBoard").when(F.col("c_custkey") % 6 == 3, "trustedboard")
    status = V.country_status(country, place, "india", _HOME, _AWAY)
    return t.customer.select("c_custkey", V.eligibility(status, place, body, source, _HOME, ["gulf", "dubai"], ["trustedboard"]).alias("e")).select("c_custkey", "e.*")


@query("c05_first_failure", """
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'title' WHEN p_size < 10 THEN 'url' WHEN p_name LIKE '%red%' OR p_name LIKE '%cold%' THEN 'news' WHEN p_retailprice < 910 THEN 'age' END AS reason FROM part""")  # fmt: skip
def c05(t: Tables) -> DataFrame:
    title = F.when(F.col("p_partkey") % 7 != 0, F.col("p_name"))
    checks = [("title", title.isNull()), ("url", F.col("p_size") < 10), ("news", title.contains("red") | title.contains("cold")), ("age", F.col("p_retailprice") < 910)]
    return t.part.select("p_partkey", V.first_failure(checks).alias("reason"))


@query("c06_graded", """
SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN 'B' WHEN 2 THEN 'A' WHEN 3 THEN 'A' WHEN 4 THEN 'B' WHEN 5 THEN 'C' WHEN 6 THEN 'U' END AS tier,
CAST([0, 62, 68, 76, 70, 45, 35, 0][p_partkey % 8 + 1] AS INTEGER) AS score, ['never', 'stated', 'direct', 'direct', 'general degree', 'near', 'unclear', 'none'][p_partkey % 8 + 1] AS reason FROM part""")  # fmt: skip
def c06(t: Tables) -> DataFrame:
    text = _said("p_partkey", 8, "civil judge, site engineer", "clerk {p_size}", "Site Engineer {p_size}", "site engineer, road works", "any engineering discipline at PWD", "architect {p_size}", "junior engineer at PWD", "junior engineer {p_size}")
    employer = V.has_word(text, ["pwd"])
    stated = F.when(F.col("p_partkey") % 8 == 1, True)
    grade = V.graded(text, stated, ["civil judge"], ["site engineer", "road works", "bridge"], ["any engineering discipline"], ["architect"], ["junior engineer"], employer)
    return t.part.select("p_partkey", grade.alias("g")).select("p_partkey", "g.tier", F.col("g.score").cast("int").alias("score"), "g.reason")


@query("e18_work_type", "SELECT p_partkey, ['Hybrid', 'Remote', 'Site', 'Office', NULL][p_partkey % 5 + 1] AS kind FROM part")
def e18(t: Tables) -> DataFrame:
    text = _said("p_partkey", 5, "remote or Hybrid", "work from home, site visits", "on-site {p_size}", "design office", "{p_name}")
    return t.part.select("p_partkey", first_label(D.WORK_TYPES, text).alias("kind"))


@query("s18_robots", """
WITH p AS (SELECT s_suppkey, unnest(['/a/x', '/a/b/c', '/z.pdf', '/z.pdf?q']) AS path FROM supplier)
SELECT s_suppkey, path, CASE s_suppkey % 4 WHEN 0 THEN path IN ('/a/b/c', '/z.pdf?q') WHEN 1 THEN path LIKE '/a%' WHEN 2 THEN TRUE ELSE path <> '/a/x' END AS allowed FROM p""")  # fmt: skip
def s18(t: Tables) -> DataFrame:
    text = _said(
        "s_suppkey",
        4,
        "User-agent: Other\nDisallow: /\n\nUser-agent: *\r\nDisallow: /a/ # no\nAllow: /a/b\nDisallow: /*.pdf$",
        "User-Agent: MyBot\nUser-agent: Other\nDisallow: /z\nUser-agent: *\nDisallow: /",
        "Disallow: /\nnothing here for {s_name}\nUser-agent: other\nDisallow: /\nUser-agent: *\nDisallow:",
        "user-agent: mybot\nallow: /\ndisallow: /\ndisallow: /a/x*\nallow: /a/\nsitemap: x\nuser-agent: mybot\nallow: /*q",
    )
    sites = t.supplier.select("s_suppkey", text.alias("text"))
    paths = F.explode(F.array(*map(F.lit, ("/a/x", "/a/b/c", "/z.pdf", "/z.pdf?q"))))
    links = t.supplier.select("s_suppkey", paths.alias("path")).withColumn("link", F.concat_ws(" ", "s_suppkey", "path"))
    found = V.allowed(links, V.robots_rules(sites, "s_suppkey", "text", "mybot"), "s_suppkey", "link", F.col("path"))
    return found.select("s_suppkey", "path", "allowed")


@query("x12_canonical", """SELECT p_partkey, sha256('{"a":' || p_size || ',"b":{"x":[2,1],"y":"' || p_name || '"}}') AS hash FROM part""")
def x12(t: Tables) -> DataFrame:
    said = F.concat(F.lit('{"b": {"y": "'), "p_name", F.lit('", "x": [2, 1]}, "a": '), F.col("p_size").cast("string"), F.lit("}"))
    return t.part.select("p_partkey", F.sha2(D.canonical_json(said), 256).alias("hash"))


@query("r03_relevance", """
SELECT p_partkey, CAST(CASE WHEN p_name LIKE '%red widget%' THEN 55 WHEN len(list_intersect(string_split(p_name, ' '), ['red', 'widget'])) > 0 THEN 38 ELSE least(30, 7 * (contains(p_name, 'red')::INT + contains(p_name, 'widget')::INT)) END
+ CASE WHEN p_type = 'ECONOMY' THEN 35 WHEN p_type = 'PROMO' THEN 8 ELSE -8 END + CASE WHEN p_size < 40 THEN 12 ELSE -30 END
+ CASE WHEN p_size < 2 THEN 10 WHEN p_size < 7 THEN 6 WHEN p_size < 30 THEN 2 ELSE 0 END + CASE WHEN p_brand = 'Brand#1' THEN 2 ELSE 0 END AS INTEGER) AS score FROM part""")  # fmt: skip
def r03(t: Tables) -> DataFrame:
    name, size = F.col("p_name"), F.col("p_size")
    where = F.when(F.col("p_type") == "PROMO", "remote").otherwise(F.lower("p_type"))
    score = scores.relevance("red widget", "economy", name, name, F.lower("p_brand"), where, size < 40, size, F.col("p_brand") == "Brand#1")
    return t.part.select("p_partkey", score.cast("int").alias("score"))


@query("r05_related", """
WITH s AS (SELECT p_partkey, CASE WHEN p_name LIKE '%widget%' THEN 35 ELSE 0 END + least(30, 10 * (contains(p_name, 'cold')::INT + contains(p_name, 'blue')::INT)) + CASE WHEN p_type = 'PROMO' THEN 20 ELSE 0 END + CASE WHEN p_brand = 'Brand#5' THEN 8 ELSE 0 END + CASE WHEN p_size > 40 THEN 2 ELSE 0 END AS score FROM part)
SELECT p_partkey, CAST(score AS INTEGER) AS score FROM s WHERE score >= 25 ORDER BY score DESC, p_partkey LIMIT 4""")  # fmt: skip
def r05(t: Tables) -> DataFrame:
    name = F.col("p_name")
    score = scores.related("red widget", ["cold", "blue"], "promo", "Brand#5", name, name, F.lower("p_type"), F.col("p_brand"), F.col("p_size") > 40)
    return t.part.select("p_partkey", score.cast("int").alias("score")).where("score >= 25").orderBy(F.desc("score"), "p_partkey").limit(4)

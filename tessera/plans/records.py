"""Queries of JSON records, imports, reviewed merges, claims, news, weighted categories, alerts and mixed searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.fields import by_words
from tessera.operators import sinks
from tessera.operators import verdicts as V
from tessera.plans.fields import _said
from tessera.plans.registry import NOW, Tables, query
from tessera.sources import records


@query("s03_spelled", "SELECT p_partkey, p_name AS title, CASE WHEN p_partkey % 3 < 2 THEN p_brand END AS org, CASE WHEN p_partkey % 3 = 2 THEN p_size::VARCHAR END AS pay FROM part")
def s03(t: Tables) -> DataFrame:
    name, brand, k = F.col("p_name"), F.col("p_brand"), F.col("p_partkey") % 3
    nested = F.to_json(F.struct(name.alias("title"), F.struct(brand.alias("name")).alias("company")))
    flat = F.to_json(F.struct(name.alias("job_title"), F.lit(" ").alias("title"), brand.alias("company_name")))
    json = F.when(k == 0, nested).when(k == 1, flat).otherwise(F.to_json(F.struct(name.alias("position"), F.col("p_size").alias("salary"))))
    fields = {"title": ["$.title", "$.job_title", "$.position"], "org": ["$.company_name", "$.company.name"], "pay": ["$.salary"]}
    return t.part.select("p_partkey", *records.spelled(json, fields))


@query("s04_stacked", """
SELECT c_custkey AS id, c_acctbal AS balance, NULL::VARCHAR AS name FROM customer WHERE c_acctbal > 0 UNION ALL SELECT s_suppkey, NULL, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")  # fmt: skip
def s04(t: Tables) -> DataFrame:
    first = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    return records.stacked(first, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), "id").select("id", "balance", "name")


@query("s15_imported", "SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'no object' WHEN 2 THEN 'k is missing' WHEN 3 THEN 'n is no number' WHEN 4 THEN 'no object' END AS reason FROM events")
def s15(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    json = F.when(k == 0, F.col("props")).when(k == 1, F.substring("props", 1, 4)).when(k == 2, '{"k": " "}').when(k == 3, '{"k": 1, "n": "x1"}').otherwise("[1]")
    return records.imported(t.events.select("event_id", json.alias("json")), "json", ["k"], ["n"]).select("event_id", "reason")


@query("k05_sitemap", "SELECT o_orderkey, '<url><loc>https://x.org/?a=' || o_orderkey || '&amp;b=1</loc>' || CASE WHEN o_orderstatus = 'F' THEN '<lastmod>' || strftime(o_orderdate, '%Y-%m-%d') || '</lastmod>' ELSE '' END || '</url>' AS entry FROM orders")
def k05(t: Tables) -> DataFrame:
    day = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return t.orders.select("o_orderkey", records.sitemap_entry(F.concat(F.lit("https://x.org/?a="), F.col("o_orderkey").cast("string"), F.lit("&b=1")), day).alias("entry"))


@query("e20_reviewed", """
SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE p_brand END AS post, CASE WHEN p_size > 25 AND p_partkey % 2 = 0 THEN 'https://a.gov/' ELSE 'https://b.' || CASE WHEN p_partkey % 2 = 0 THEN 'com/' ELSE 'gov/' END END || p_partkey AS link FROM part""")  # fmt: skip
def e20(t: Tables) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    old = t.part.select("p_partkey", F.col("p_name").alias("post"), F.concat(F.when(F.col("p_size") > 25, "https://a.gov/").otherwise("https://a.com/"), key).alias("link"))
    new = t.part.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_brand")).alias("post"), F.concat(F.when(F.col("p_partkey") % 2 == 0, "https://b.com/").otherwise("https://b.gov/"), key).alias("link"))
    return sinks.reviewed(old, new, "p_partkey", "link", F.col("link").rlike(r"^https://[a-z]+\.gov/"))


@query("o07_claimed", f"""
WITH s AS (SELECT event_id, ts, CASE event_type WHEN 'click' THEN CASE WHEN TIMESTAMP '{NOW}' - ts > INTERVAL 240 HOUR THEN 'uncertain' ELSE 'publishing' END WHEN 'view' THEN 'queued' ELSE 'sent' END AS state FROM events),
m AS (SELECT event_id FROM s WHERE state = 'queued' ORDER BY event_id LIMIT 50)
SELECT event_id, CASE WHEN event_id IN (FROM m) THEN 'publishing' ELSE state END AS state, CASE WHEN event_id IN (FROM m) THEN TIMESTAMP '{NOW}' ELSE ts END AS leased, CASE WHEN event_id IN (FROM m) THEN 'w1' END AS worker FROM s""")  # fmt: skip
def o07(t: Tables) -> DataFrame:
    state = F.when(F.col("event_type") == "click", "publishing").when(F.col("event_type") == "view", "queued").otherwise("sent")
    ledger = t.events.select("event_id", state.alias("state"), F.col("ts").cast("timestamp_ntz").alias("leased"))
    return sinks.claimed(ledger, "event_id", "state", "leased", F.lit(NOW).cast("timestamp_ntz"), 240 * 3600, 50, "w1")


@query("c02_news", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'noise in headline' WHEN 1 THEN 'no vacancy' END AS reason FROM part")
def c02(t: Tables) -> DataFrame:
    headline = _said("p_partkey", 4, "Exam syllabus: {p_size} vacancies", "{p_name} opens", "{p_size} vacancies", "{p_name}")
    body = _said("p_partkey", 4, "vacancies", "a bridge", "syllabus follows", "recruitment of {p_size}")
    return t.part.select("p_partkey", V.news(headline, body, ["syllabus", "answer key"], ["vacancies", "recruitment"]).alias("reason"))


@query("c11_weightiest", "SELECT p_partkey, [NULL, 'site', 'design', 'site', NULL][p_partkey % 5 + 1] AS category, [0.0, 1.0, 0.8, 0.6, 0.0][p_partkey % 5 + 1]::DOUBLE AS score FROM part")
def c11(t: Tables) -> DataFrame:
    title = _said("p_partkey", 5, "Software site lead", "Site engineer", "Lead {p_size}", "Lead", "Lead")
    text = _said("p_partkey", 5, "site", "design", "estimate on site, structural design", "site, estimate", "{p_name}")
    return t.part.select("p_partkey", V.weightiest(title, text, [("site", 3, ["site"]), ("estimate", 3, ["estimate"]), ("design", 4, ["design"])], ["software"]).alias("c")).select("p_partkey", "c.*")


@query("c14_exam_kind", "SELECT p_partkey, ['prep', 'junior', 'structures', 'survey', 'general'][p_partkey % 5 + 1] AS kind FROM part")
def c14(t: Tables) -> DataFrame:
    kinds = {"prep": ("gate", "ese"), "junior": ("ssc ?je", "rrb ?je"), "structures": ("structural", "concrete"), "survey": ("survey*", "levelling")}
    text = _said("p_partkey", 5, "GATE structural {p_size}", "SSC JE survey", "reinforced concrete", "Surveying {p_size}", "{p_name}")
    return t.part.select("p_partkey", by_words(kinds, text, "general").alias("kind"))


@query("g18_inbox", "SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS waiting, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS lately, count(DISTINCT o_custkey) AS senders FROM orders")
def g18(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    return t.orders.agg(F.count_if(status == "O").alias("waiting"), F.count_if(status == "F").alias("done"), F.count_if(F.col("o_orderdate") >= "1998-01-01").alias("lately"), F.count_distinct("o_custkey").alias("senders"))


@query("f15_residual", "SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND (regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') = 'brand-1' OR contains(lower(p_brand), 'brand#2')) AND contains(lower(p_name), 'widget')")
def f15(t: Tables) -> DataFrame:
    brand = F.lower("p_brand")
    rows = t.part.where("p_type = 'ECONOMY'")
    return rows.where(((F.regexp_replace(brand, "[^a-z0-9]+", "-") == "brand-1") | brand.contains("brand#2")) & F.lower("p_name").contains("widget")).select("p_partkey")


@query("r11_mixed_search", """
WITH a AS (SELECT 'part' AS of, p_partkey AS id, p_name AS title, p_name || ' ' || p_brand AS body FROM part UNION ALL SELECT 'customer', c_custkey, c_mktsegment, c_name FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, 'widget supplier' FROM supplier),
s AS (SELECT of, id, (CASE WHEN contains(lower(title), 'widget') THEN 55 ELSE 0 END + CASE WHEN contains(lower(body), 'widget') THEN 20 ELSE 0 END)::INTEGER AS score FROM a)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, of, id LIMIT 60""")  # fmt: skip
def r11(t: Tables) -> DataFrame:
    one = lambda rows, of, key, title, body: rows.select(F.lit(of).alias("of"), F.col(key).alias("id"), F.col(title).alias("title"), body.alias("body"))
    rows = one(t.part, "part", "p_partkey", "p_name", F.concat_ws(" ", "p_name", "p_brand")).union(one(t.customer, "customer", "c_custkey", "c_mktsegment", F.col("c_name"))).union(one(t.supplier, "supplier", "s_suppkey", "s_name", F.lit("widget supplier")))
    score = F.when(F.lower("title").contains("widget"), 55).otherwise(0) + F.when(F.lower("body").contains("widget"), 20).otherwise(0)
    return rows.select("of", "id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "of", "id").limit(60)

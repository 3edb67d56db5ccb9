"""Filters and pages over orders, customers, events and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import listing as L
from tessera.operators import predicates as P
from tessera.plans.registry import NOW, Tables, query



def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def _orders(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))


_JOINED = "orders JOIN customer ON o_custkey = c_custkey"


@query("l01_page", f"""
SELECT o_orderkey, c_name, o_orderstatus, o_totalprice FROM {_JOINED}
WHERE (o_orderstatus = 'O' OR o_orderstatus = 'F') AND (contains(lower(c_name), '00007') OR contains(lower(c_mktsegment), 'build'))
ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 40 OFFSET 40""")  # fmt: skip
def l01_page(t: Tables) -> DataFrame:
    rows = _orders(t).where(F.col("o_orderstatus").isin("O", "F") & P.contains_in_any(["c_name", "c_mktsegment"], "00007") | F.col("o_orderstatus").isin("O", "F") & P.contains(F.col("c_mktsegment"), "BUILD"))
    return L.page(rows, [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey")], L.page_of(2, 40)).select("o_orderkey", "c_name", "o_orderstatus", "o_totalprice")


@query("l01_page_info", "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 40)) AS BIGINT) AS pages, 2 < greatest(1, ceil(count(*) / 40)) AS has_next FROM orders WHERE o_orderstatus = 'P'")
def l01_page_info(t: Tables) -> DataFrame:
    return L.page_info(t.orders.where("o_orderstatus = 'P'"), L.page_of("2", 40))


@query("l02_unknown_dates_last", """
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS deadline FROM orders
ORDER BY deadline ASC NULLS LAST, o_orderkey LIMIT 100 OFFSET 9900""")  # fmt: skip
def l02(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("deadline"))
    return L.page(rows, [F.col("deadline").asc_nulls_last(), F.col("o_orderkey")], L.page_of(100, 100))


@query("l03_composite_order", """
SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_type = 'PROMO' DESC, p_size DESC NULLS LAST, p_partkey DESC LIMIT 50""")  # fmt: skip
def l03(t: Tables) -> DataFrame:
    order = [(F.col("p_type") == "PROMO").desc(), F.col("p_size").desc_nulls_last(), F.col("p_partkey").desc()]
    return L.page(t.part, order, L.page_of(1, 50)).select("p_partkey", "p_brand", "p_size")


@query("l04_fresh_then_backup", f"""
WITH a AS (SELECT event_id, date_diff('millisecond', ts, TIMESTAMP '{NOW}') AS age FROM events)
SELECT event_id, CASE WHEN age <= 86400000 THEN 0 WHEN age <= 86400000 * 10 THEN 1 ELSE 2 END AS bucket FROM a
ORDER BY bucket, age, event_id LIMIT 80""")  # fmt: skip
def l04(t: Tables) -> DataFrame:
    age = F.timestamp_diff("MILLISECOND", F.col("ts"), now())
    rows = t.events.select("event_id", age.alias("age"))
    bucket = F.when(F.col("age") <= 86400000, 0).when(F.col("age") <= 864000000, 1).otherwise(2)
    return rows.withColumn("bucket", bucket).orderBy("bucket", F.col("age").asc_nulls_last(), "event_id").limit(80).select("event_id", "bucket")


@query("l05_brief", """
(SELECT 'newest' AS section, o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 5)
UNION ALL (SELECT 'dearest' AS section, o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3)
UNION ALL (SELECT 'urgent' AS section, o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey LIMIT 6)""")  # fmt: skip
def l05(t: Tables) -> DataFrame:
    o = t.orders.withColumn("id", F.col("o_orderkey"))
    newest, key = F.col("o_orderdate").desc(), F.col("o_orderkey")
    return L.sections({"newest": (o, [newest, key], 5), "dearest": (o, [F.col("o_totalprice").desc(), key], 3), "urgent": (o.where("o_orderpriority = '1-URGENT'"), [newest, key], 6)}, ["id"])


@query("l07_best", """
WITH s AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 50 ELSE 0 END + CASE WHEN c_acctbal > 5000 THEN 45 ELSE 0 END + CASE WHEN c_nationkey < 5 THEN 3 ELSE 0 END AS score FROM customer)
SELECT c_custkey, CAST(score AS INTEGER) AS score FROM s WHERE score >= 95 ORDER BY score DESC, c_custkey LIMIT 12""")  # fmt: skip
def l07(t: Tables) -> DataFrame:
    hit = lambda test, n: F.when(test, n).otherwise(0)
    score = hit(F.col("c_mktsegment") == "BUILDING", 50) + hit(F.col("c_acctbal") > 5000, 45) + hit(F.col("c_nationkey") < 5, 3)
    return L.best(t.customer.select("c_custkey", score.alias("score")), "score", 95, [F.col("score").desc(), F.col("c_custkey")], 12)


@query("f01_allowed_columns", "SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal FROM customer")
def f01(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"))


@query("f02_not_expired", f"SELECT event_id FROM events WHERE CASE WHEN event_type <> 'error' THEN ts END IS NULL OR ts >= TIMESTAMP '{NOW}' - INTERVAL 3 DAY")
def f02(t: Tables) -> DataFrame:
    expiry = F.when(F.col("event_type") != "error", F.col("ts"))
    return t.events.where(P.not_expired(expiry, now() - F.expr("INTERVAL 3 DAYS"))).select("event_id")


@query("f02_first_known_date", f"SELECT event_id FROM events WHERE NOT coalesce(coalesce(CASE WHEN event_type = 'view' THEN ts END, CASE WHEN event_type = 'click' THEN ts + INTERVAL 9 DAY END) < TIMESTAMP '{NOW}' - INTERVAL 5 DAY, false)")
def f02b(t: Tables) -> DataFrame:
    dates = [F.when(F.col("event_type") == "view", F.col("ts")), F.when(F.col("event_type") == "click", F.col("ts") + F.expr("INTERVAL 9 DAYS"))]
    return t.events.where(P.first_known_not_past(dates, now() - F.expr("INTERVAL 5 DAYS"))).select("event_id")


@query("f03_contains_in_any", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')")
def f03(t: Tables) -> DataFrame:
    return t.part.where(P.contains_in_any(["p_name", "p_brand", "p_type"], "RING")).select("p_partkey")


@query("f04_contains_in_each", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') AND contains(lower(p_brand), '#1')")
def f04(t: Tables) -> DataFrame:
    return t.part.where(P.contains_in_each({"p_name": "Red", "p_brand": "#1", "p_type": ""})).select("p_partkey")


@query("f05_any_value", "SELECT p_partkey FROM part WHERE (contains(lower(p_type), 'promo') OR contains(lower(p_type), 'economy') OR contains(lower(p_type), 'small')) AND (contains(lower(p_name), 'ring') OR contains(lower(p_name), 'widget'))")
def f05(t: Tables) -> DataFrame:
    return t.part.where(P.any_value(["p_type"], "promo, cheap", {"cheap": "economy"}) & P.any_value(["p_name"], "ring,widget") | P.any_value(["p_type"], "small") & P.any_value(["p_name"], "ring,widget")).select("p_partkey")


@query("f06_lifecycle", "SELECT o_orderkey FROM orders WHERE NOT (o_orderpriority = '1-URGENT') AND o_orderstatus <> 'F'")
def f06(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "Deleted").otherwise("Open")
    return t.orders.where(P.lifecycle("draft", F.col("o_orderpriority") == "1-URGENT", status)).select("o_orderkey")


@query("f07_default_sector", "SELECT c_custkey FROM customer WHERE nullif(c_mktsegment, 'BUILDING') = 'MACHINERY' OR nullif(c_mktsegment, 'BUILDING') IS NULL")
def f07(t: Tables) -> DataFrame:
    return t.customer.where(P.sector(F.nullif("c_mktsegment", F.lit("BUILDING")), "MACHINERY", "MACHINERY")).select("c_custkey")


@query("f08_none_contains", "WITH p AS (SELECT p_partkey, p_name, nullif(p_type, 'PROMO') AS kind FROM part) SELECT p_partkey FROM p WHERE NOT (contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue') OR contains(lower(kind), 'red') OR contains(lower(kind), 'blue'))")
def f08(t: Tables) -> DataFrame:
    return t.part.withColumn("kind", F.nullif("p_type", F.lit("PROMO"))).where(P.none_contains(["p_name", "kind"], ["red", "blue"])).select("p_partkey")


@query("f09_at_most_or_unknown", "SELECT p_partkey FROM part WHERE nullif(p_size, 13) <= 5 OR nullif(p_size, 13) IS NULL")
def f09(t: Tables) -> DataFrame:
    return t.part.where(P.at_most_or_unknown(F.nullif("p_size", F.lit(13)), 5)).select("p_partkey")


@query("f10_recent", f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY")
def f10(t: Tables) -> DataFrame:
    return t.events.where(P.recent([F.col("ts"), F.lit(None).cast("timestamp_ntz")], now(), 7)).select("event_id")


@query("f11_at_least_or_unknown", "SELECT c_custkey FROM customer WHERE CASE WHEN c_acctbal >= 0 THEN c_acctbal END >= 9000 OR CASE WHEN c_acctbal >= 0 THEN c_acctbal END IS NULL")
def f11(t: Tables) -> DataFrame:
    return t.customer.where(P.at_least_or_unknown(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")), 9000)).select("c_custkey")


@query("f12_literal_wildcards", "SELECT page_id FROM pages WHERE contains(lower(url), 'utm_s')")
def f12(t: Tables) -> DataFrame:
    return t.pages.where(P.contains(F.col("url"), "utm_s")).select("page_id")


@query("f13_band", "SELECT p_partkey, 'near' AS part FROM part WHERE p_size BETWEEN 5 AND 9 UNION ALL SELECT p_partkey, 'open' AS part FROM part WHERE p_size BETWEEN 10 AND 45")
def f13(t: Tables) -> DataFrame:
    near = t.part.where(P.band(F.col("p_size"), 7)).select("p_partkey", F.lit("near").alias("part"))
    return near.union(t.part.where(P.band(F.col("p_size"), 12)).select("p_partkey", F.lit("open").alias("part")))


@query("f14_has_all", "SELECT doc_id FROM documents WHERE list_contains(string_split(text, ' '), 'the') AND list_contains(string_split(text, ' '), 'of')")
def f14(t: Tables) -> DataFrame:
    return t.documents.where(P.has_all(F.split("text", " "), ["the", "of"])).select("doc_id")


@query("f16_within_days", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1998-03-01' AND DATE '1998-03-08'")
def f16(t: Tables) -> DataFrame:
    return t.orders.where(P.within_days(F.col("o_orderdate").cast("date"), F.lit("1998-03-01").cast("date"), 7)).select("o_orderkey")


#: URLs by page_id % 10, and whether each is safe; pages of other remainders have their own.
_ODD_URLS = [("http://192.168.1.9/x", False), ("javascript:alert(1)", False), ("http://user@127.0.0.1/", False), ("http://[::1]/", False), ("http://a.localhost/", False), ("http://127.0.0.1:80@evil.com/", True)]


@query("f17_safe_url", f"SELECT page_id, CASE {' '.join(f'WHEN page_id % 10 = {i} THEN {ok}' for i, (_, ok) in enumerate(_ODD_URLS))} ELSE url LIKE 'http%://%' END AS safe FROM pages")
def f17(t: Tables) -> DataFrame:
    url = F.coalesce(*[F.when(F.col("page_id") % 10 == i, F.lit(u)) for i, (u, _) in enumerate(_ODD_URLS)], F.col("url"))
    return t.pages.select("page_id", P.safe_url(url).alias("safe"))


@query("f18_host_in", r"WITH h AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages) SELECT page_id FROM h WHERE page_id % 7 = 1 OR page_id % 7 > 1 AND url LIKE 'https://%' AND (host = 'example.net' OR host LIKE '%.example.net' OR host = 'example.org' OR host LIKE '%.example.org')")
def f18(t: Tables) -> DataFrame:
    k = F.col("page_id") % 7
    url = F.when(k == 0, "https://example.org:80@evil.com/").when(k == 1, "https://user:word@www.example.net:8080/x").otherwise(F.col("url"))
    return t.pages.where(P.host_in(url, ["example.net", "example.org"])).select("page_id")


_FLAGS = [("short", "n_chars < 400"), ("no_capital", "NOT regexp_like(text, '[A-Z]')"), ("one_line", "instr(text, chr(10)) = 0"), ("symbols", "regexp_like(text, '[#*$%]')"), ("not_english", "lang <> 'en'")]


@query("f20_flags_and_score", "SELECT doc_id, array_to_string(f, ',') AS flags, CAST(greatest(0, 100 - 15 * len(f)) AS INTEGER) AS score FROM (SELECT doc_id, [x FOR x IN [CASE WHEN n_chars < 400 THEN 'short' END, CASE WHEN NOT regexp_matches(text, '[A-Z]') THEN 'no_capital' END, CASE WHEN instr(text, chr(10)) = 0 THEN 'one_line' END, CASE WHEN regexp_matches(text, '[#*$%]') THEN 'symbols' END, CASE WHEN lang <> 'en' THEN 'not_english' END] IF x IS NOT NULL] AS f FROM documents)")
def f20(t: Tables) -> DataFrame:
    found = P.flags([(label, F.expr(test)) for label, test in _FLAGS])
    return t.documents.withColumn("f", found).select("doc_id", F.array_join("f", ",").alias("flags"), P.flag_score(F.col("f")).alias("score"))


@query("f21_publish_gates", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' WHEN o_totalprice < 50000 THEN 'too small' WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'past' END AS reason FROM orders")
def f21(t: Tables) -> DataFrame:
    gates = [("closed", F.col("o_orderstatus") == "F"), ("too small", F.col("o_totalprice") < 50000), ("past", F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"))]
    return t.orders.select("o_orderkey", P.first_reason(gates).alias("reason"))


@query("f23_valid_or_null", "SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 9000 THEN c_acctbal END AS balance FROM customer")
def f23(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", P.or_null(F.col("c_acctbal"), F.col("c_acctbal").between(0, 9000)).alias("balance"))


@query("f24_mislabelled", r"SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://(m|blog)\.') AND NOT regexp_matches(url, '\.org/') AND regexp_matches(url, '/(en|fr)/')")
def f24(t: Tables) -> DataFrame:
    return t.pages.where(F.col("url").rlike(r"^https?://(m|blog)\.") & ~F.col("url").rlike(r"\.org/") & F.col("url").rlike("/(en|fr)/")).select("page_id")

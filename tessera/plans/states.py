"""Dates, lists, scores, classes, merges and ledgers over events, orders, parts and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import values as V
from tessera.operators import states as O
from tessera.operators.predicates import first_reason
from tessera.plans.registry import NOW, Tables, query

_AGE = f"date_diff('millisecond', ts, TIMESTAMP '{NOW}' - INTERVAL 1 DAY)"


def _age(days: int = 1):
    return F.timestamp_diff("MILLISECOND", F.col("ts"), F.lit(NOW).cast("timestamp_ntz") - F.make_interval(days=F.lit(days)))


@query("t01_freshness", f"SELECT event_id, CASE WHEN a < -7200000 THEN 'future' WHEN a <= 86400000 THEN 'fresh' WHEN a <= 2592000000 THEN 'backup' ELSE 'too_old' END AS class FROM (SELECT event_id, {_AGE} AS a FROM events)")
def t01(t: Tables) -> DataFrame:
    return t.events.select("event_id", V.freshness(_age()).alias("class"))


@query("t02_age_text", f"SELECT event_id, CASE WHEN a >= 2592000000 THEN (a // 2592000000) || ' month' WHEN a >= 604800000 THEN (a // 604800000) || ' week' WHEN a >= 86400000 THEN (a // 86400000) || ' day' WHEN a >= 3600000 THEN (a // 3600000) || ' hour' WHEN a >= 60000 THEN (a // 60000) || ' min' ELSE 'now' END AS age FROM (SELECT event_id, {_AGE} AS a FROM events)")
def t02(t: Tables) -> DataFrame:
    return t.events.select("event_id", V.age_text(_age()).alias("age"))


@query("t04_days_left", "SELECT o_orderkey, CAST(date_diff('day', DATE '1997-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS days, date_diff('day', DATE '1997-01-01', CAST(o_orderdate AS DATE)) BETWEEN 0 AND 5 AS soon FROM orders")
def t04(t: Tables) -> DataFrame:
    day, today = F.col("o_orderdate").cast("date"), F.lit("1997-01-01").cast("date")
    return t.orders.select("o_orderkey", V.days_left(day, today).alias("days"), V.closing_soon(day, today).alias("soon"))


@query("t05_end_of_day", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + INTERVAL '23:59:59' AS ends FROM orders".replace("INTERVAL '23:59:59'", "TIME '23:59:59'"))
def t05(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", V.end_of_day(F.col("o_orderdate").cast("date")).alias("ends"))


@query("t08_local_day_start", "SELECT event_id, date_trunc('day', ts + INTERVAL 330 MINUTE)::TIMESTAMP - INTERVAL 330 MINUTE AS began FROM events")
def t08(t: Tables) -> DataFrame:
    return t.events.select("event_id", V.local_day_start(F.col("ts"), "Asia/Kolkata").alias("began"))


@query("t11_half_up", "SELECT c_custkey, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS balance FROM customer")
def t11(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", V.half_up(F.col("c_acctbal")).alias("balance"))


@query("e17_monthly", "SELECT o_orderkey, CAST(floor(CASE WHEN o_totalprice < 1000 THEN o_totalprice * 1000 WHEN o_totalprice < 120000 THEN o_totalprice ELSE o_totalprice / 12 END + 0.5) AS BIGINT) AS amount FROM orders")
def e17(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", V.monthly(F.col("o_totalprice")).alias("amount"))


@query("y01_listed", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 OR p_type = 'x' THEN array_to_string([p_type, p_brand], '/') ELSE array_to_string([p_type, p_name], '/') END AS parts FROM part")
def y01(t: Tables) -> DataFrame:
    json = F.to_json(F.array("p_type", "p_brand", "p_type"))
    line = F.when(F.col("p_partkey") % 2 == 0, json).otherwise(F.concat("p_type", F.lit(" ; "), "p_name", F.lit(",| "), "p_type"))
    return t.part.select("p_partkey", F.array_join(V.listed(line, 5), "/").alias("parts"))


@query("y03_json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def y03(t: Tables) -> DataFrame:
    return t.events.select("event_id", V.json_field(F.col("props"), "$.k", "int").alias("k"))


@query("y07_provenance", "SELECT c_custkey, 'segment' AS field, c_mktsegment AS value FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT c_custkey, 'name', c_name FROM customer")
def y07(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.col("c_name").alias("name"))
    return rows.unpivot("c_custkey", ["segment", "name"], "field", "value").where("value IS NOT NULL")


@query("y08_filled", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS label FROM customer")
def y08(t: Tables) -> DataFrame:
    old = F.when(F.col("c_custkey") % 3 == 0, "  ").otherwise(F.col("c_mktsegment"))
    return t.customer.select("c_custkey", V.filled(old, F.col("c_name")).alias("label"))


@query("r02_confidence", "SELECT doc_id, CAST(least(95, 25 + CASE WHEN n_chars >= 80 THEN 5 ELSE 0 END + CASE WHEN contains(text, '@') THEN 15 ELSE 0 END + CASE WHEN lang = 'en' THEN 40 ELSE 0 END + CASE WHEN contains(text, 'http') THEN 20 ELSE 0 END) AS INTEGER) AS score FROM documents")
def r02(t: Tables) -> DataFrame:
    has = F.col("text").contains
    score = O.points([(F.col("n_chars") >= 80, 5), (has("@"), 15), (F.col("lang") == "en", 40), (has("http"), 20)])
    return t.documents.select("doc_id", F.least(F.lit(95), score + 25).alias("score"))


@query("c04_ordered_classes", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN NULL WHEN regexp_matches(p_name, 'red|blue') THEN 'colour' WHEN p_size > 40 THEN 'large' END AS class, CASE WHEN p_type = 'PROMO' THEN 'vetoed' WHEN p_size < 3 THEN 'small' END AS reason FROM part")
def c04(t: Tables) -> DataFrame:
    veto = F.col("p_type") == "PROMO"
    named = F.when(~veto, F.coalesce(X.first_label([("colour", "red|blue")], F.col("p_name")), F.when(F.col("p_size") > 40, "large")))
    return t.part.select("p_partkey", named.alias("class"), first_reason([("vetoed", veto), ("small", F.col("p_size") < 3)]).alias("reason"))


@query("o06_not_sent", "SELECT DISTINCT user_id, event_type FROM events WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE value > 300)")
def o06(t: Tables) -> DataFrame:
    keys = ["user_id", "event_type"]
    return O.not_sent(t.events.select(*keys), t.events.where("value > 300").select(*keys), keys)


@query("o08_merged", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_mktsegment WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer UNION ALL SELECT -1, 'NEW'")
def o08(t: Tables) -> DataFrame:
    old = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    new = t.customer.where("c_custkey % 2 = 0").select("c_custkey", F.lit("NEW").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    extra = t.spark.range(1).select(F.lit(-1).cast("bigint").alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return O.merged(old, new.union(extra), ["c_custkey"], F.col("c_acctbal") < 0).select("c_custkey", "c_mktsegment")


@query("o08_latest", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) = 1")
def o08_latest(t: Tables) -> DataFrame:
    return O.latest(t.events, ["user_id"], [F.col("ts").desc(), F.col("event_id")]).select("user_id", "event_id")


@query("o10_conflicts", "SELECT p_partkey, 'p_size' AS field, p_size::VARCHAR AS old, least(p_size, 30)::VARCHAR AS new FROM part WHERE p_size > 30 UNION ALL SELECT p_partkey, 'p_type', p_type, 'PROMO' FROM part WHERE p_type <> 'PROMO' AND p_partkey % 7 = 0")
def o10(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 7 == 0, "PROMO").otherwise(F.col("p_type"))
    new = t.part.select("p_partkey", F.least("p_size", F.lit(30)).alias("p_size"), kind.alias("p_type"))
    return O.conflicts(t.part, new, ["p_partkey"], ["p_size", "p_type"])


@query("o13_counters", "SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY user_id")
def o13(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "click").alias("clicks"))

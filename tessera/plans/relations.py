"""Joins, aggregates, windows and set operations over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import joins as J
from tessera.operators import ordering as O
from tessera.plans.registry import NOW, Tables, query


@query("j01_nested", """
SELECT c_custkey, count(o_orderkey) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS keys
FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")  # fmt: skip
def j01(t: Tables) -> DataFrame:
    orders = t.orders.withColumnRenamed("o_custkey", "c_custkey")
    rows = J.nested(t.customer.select("c_custkey"), orders, "c_custkey", ["o_orderkey"], "orders")
    keys = F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",")
    return rows.select("c_custkey", F.coalesce(F.size("orders"), F.lit(0)).cast("bigint").alias("n"), keys.alias("keys"))


@query("j03_absent_by_each", """
WITH o AS (SELECT o_orderkey, o_orderdate >= TIMESTAMP '1997-01-01' AS is_new, o_custkey AS c, nullif(o_orderpriority, '5-LOW') AS p, o_orderstatus AS s, day(o_orderdate) AS d FROM orders)
SELECT o_orderkey FROM o n WHERE is_new AND NOT EXISTS (SELECT 1 FROM o WHERE NOT o.is_new AND o.c = n.c AND o.d = n.d)
AND NOT EXISTS (SELECT 1 FROM o WHERE NOT o.is_new AND o.c = n.c AND o.p = n.p AND o.s = n.s)""")  # fmt: skip
def j03(t: Tables) -> DataFrame:
    key = F.when(F.col("o_orderpriority") != "5-LOW", F.concat_ws("|", "o_custkey", "o_orderpriority", "o_orderstatus"))
    rows = t.orders.withColumns({"k": key, "d": F.concat_ws("|", "o_custkey", F.day("o_orderdate"))})
    is_new = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")
    return J.absent_by_each(rows.where(is_new), rows.where(~is_new).select("k", "d"), ["d", "k"]).select("o_orderkey")


@query("j04_absent", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def j04(t: Tables) -> DataFrame:
    taken = t.orders.where("o_orderstatus = 'P'").select("o_custkey").union(t.orders.where("o_totalprice > 400000").select("o_custkey"))
    return t.customer.join(taken, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


_TITLE = r"trim(regexp_replace(lower({}), '[^a-z0-9]+', ' '{}))"


@query("j05_absent_by_title", f"SELECT p_partkey FROM part WHERE {_TITLE.format('p_name', ", 'g'")} NOT IN (SELECT {_TITLE.format('p_name', ", 'g'")} FROM part WHERE p_size > 45)")
def j05(t: Tables) -> DataFrame:
    title = F.expr(_TITLE.format("p_name", ""))
    return J.absent_by_each(t.part, t.part.where("p_size > 45"), [title]).select("p_partkey")


@query("j06_semi", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50)")
def j06(t: Tables) -> DataFrame:
    return t.supplier.join(t.lineitem.where("l_quantity >= 50"), F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey")


@query("j07_lookup", "SELECT a.o_orderkey, b.o_orderstatus AS previous FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey - 7 AND b.o_orderstatus <> 'P'")
def j07(t: Tables) -> DataFrame:
    before = t.orders.where("o_orderstatus <> 'P'").select((F.col("o_orderkey") + 7).alias("o_orderkey"), F.col("o_orderstatus").alias("previous"))
    return t.orders.select("o_orderkey").join(before, "o_orderkey", "left")


@query("j08_standing_queries", """
SELECT a.p_partkey AS alert, p.p_partkey AS part FROM part a
JOIN part p ON a.p_brand = p.p_brand AND a.p_type = p.p_type AND p.p_size >= a.p_size AND contains(p.p_name, split_part(a.p_name, ' ', 1))""")  # fmt: skip
def j08(t: Tables) -> DataFrame:
    alerts = t.part.select(F.col("p_partkey").alias("alert"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("least"), F.split("p_name", " ")[0].alias("word"))
    parts = t.part.select("p_partkey", "p_brand", "p_type", "p_name", "p_size")
    return J.matching(alerts, parts, [("brand", "p_brand"), ("kind", "p_type")], "word", "p_name", F.col("p_size") >= F.col("least")).select("alert", F.col("p_partkey").alias("part"))


@query("j09_blocked_best_match", """
WITH c AS (SELECT * FROM part), e AS (SELECT * FROM part),
p AS (SELECT c.p_partkey AS a, e.p_partkey AS b FROM c JOIN e ON c.p_name || c.p_brand = e.p_name || e.p_brand WHERE c.p_partkey <> e.p_partkey
      UNION SELECT c.p_partkey, e.p_partkey FROM c JOIN e ON c.p_size || c.p_brand = e.p_size || e.p_brand WHERE c.p_partkey <> e.p_partkey),
s AS (SELECT a, b, CASE WHEN c.p_name = e.p_name THEN 30 ELSE 0 END + CASE WHEN c.p_brand = e.p_brand THEN 20 ELSE 0 END + CASE WHEN c.p_type = e.p_type THEN 10 ELSE 0 END + CASE WHEN c.p_size = e.p_size THEN 35 ELSE 0 END AS score
      FROM p JOIN c ON a = c.p_partkey JOIN e ON b = e.p_partkey)
SELECT a, b, CAST(score AS INTEGER) AS score FROM s WHERE score >= 50 QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1""")  # fmt: skip
def j09(t: Tables) -> DataFrame:
    p = t.part.withColumns({"k1": F.concat("p_name", "p_brand"), "k2": F.concat(F.col("p_size").cast("string"), "p_brand")})
    return J.best_by_equal(p, "p_partkey", ["k1", "k2"], {"p_name": 30, "p_brand": 20, "p_type": 10, "p_size": 35}, 50)


@query("j11_match_by_priority", """
WITH e AS (SELECT o_orderkey AS eid, o_custkey AS c, o_orderpriority || o_custkey AS k FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'),
r AS (SELECT o_orderkey AS rid, o_custkey AS c, o_orderpriority || o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'),
h AS (SELECT rid, 0 AS rank, min(eid) AS eid FROM r JOIN e USING (k) GROUP BY rid UNION ALL SELECT rid, 1, min(eid) FROM r JOIN e USING (c) GROUP BY rid)
SELECT rid, CAST(min(rank) AS INTEGER) AS matched_by, arg_min(h.eid, rank) AS eid FROM r LEFT JOIN h USING (rid) GROUP BY rid""")  # fmt: skip
def j11(t: Tables) -> DataFrame:
    is_new = F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz")
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("c"), F.concat("o_orderpriority", F.col("o_custkey").cast("string")).alias("k"), is_new.alias("is_new"))
    new, old = rows.where("is_new").withColumnRenamed("o_orderkey", "rid"), rows.where("NOT is_new").withColumnRenamed("o_orderkey", "eid")
    return J.by_priority(new, old, "rid", [("k", "k"), ("c", "c")], "eid").select("rid", "matched_by", "eid")


@query("j12_dimensions", """
SELECT r_name, n_name, count(*) AS n, round(sum(CAST(o_totalprice AS DECIMAL(18,2))), 2)::DOUBLE AS total
FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name, n_name""")  # fmt: skip
def j12(t: Tables) -> DataFrame:
    places = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t.customer.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = t.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("j13_keep_one_copy", "SELECT p_name, p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY p_name, p_brand")
def j13(t: Tables) -> DataFrame:
    return O.keep_first(t.part, ["p_name", "p_brand"], [F.col("p_partkey")]).select("p_name", "p_brand", "p_partkey")


@query("j14_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def j14(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("j15_nearest_preceding", """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS user_turn FROM conversations""")  # fmt: skip
def j15(t: Tables) -> DataFrame:
    return J.preceding(t.conversations, ["conv_id"], ["turn", "role"], F.col("role") == "user", F.col("turn"), "user_turn").select("conv_id", "turn", "user_turn")


@query("j16_daily_series", """
SELECT CAST(d AS DATE) AS day, count(event_id) AS n FROM generate_series(DATE '2024-01-28', DATE '2024-02-03', INTERVAL 1 DAY) g(d)
LEFT JOIN events ON CAST(ts AS DATE) = CAST(d AS DATE) GROUP BY d""")  # fmt: skip
def j16(t: Tables) -> DataFrame:
    return J.daily_series(t.events, F.to_date("ts"), F.lit("2024-02-03").cast("date"), 7)


_PRICES = "lineitem JOIN part ON l_partkey = p_partkey"


@query("g01_spread", f"""
SELECT lower(p_brand) AS brand, lower(p_type) AS kind, min(c) AS least, max(c) AS most, CAST(floor(median(c) + 0.5) AS BIGINT) AS median,
count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_verified,
arg_min(CASE WHEN l_linenumber % 2 = 1 THEN upper(p_brand) ELSE p_brand END, l_orderkey * 100 + l_linenumber) AS spelling, CAST(floor(avg(l_quantity) + 0.5) AS BIGINT) AS mean_quantity
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM {_PRICES}) WHERE c > 0 GROUP BY 1, 2 ORDER BY n DESC, brand, kind LIMIT 36""")  # fmt: skip
def g01(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    spelled = F.when(F.col("l_linenumber") % 2 == 1, F.upper("p_brand")).otherwise(F.col("p_brand"))
    beside = [F.min_by(spelled, F.struct("l_orderkey", "l_linenumber")).alias("spelling"), A.half_up(F.avg("l_quantity")).cast("bigint").alias("mean_quantity")]
    return A.spread(rows, [F.lower("p_brand").alias("brand"), F.lower("p_type").alias("kind")], cents, F.col("l_returnflag") == "R", F.struct("brand", "kind"), 36, beside)


@query("g02_spread_exact_case", f"""
SELECT p_brand, p_size, min(c) AS least, max(c) AS most, CAST(floor(median(c) + 0.5) AS BIGINT) AS median, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS n_verified
FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM {_PRICES}) GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_size LIMIT 40""")  # fmt: skip
def g02(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return A.spread(rows, [F.col("p_brand"), F.col("p_size")], F.round(F.col("l_extendedprice") * 100).cast("bigint"), F.col("l_linestatus") == "F", F.struct("p_brand", "p_size"), 40)


@query("g03_lower_median", "SELECT c_mktsegment, quantile_disc(c_acctbal, 0.5) AS lower_median, count(*) AS n FROM customer GROUP BY c_mktsegment")
def g03(t: Tables) -> DataFrame:
    return A.middle(t.customer, [F.col("c_mktsegment")], F.col("c_acctbal")).select("c_mktsegment", F.col("lower").alias("lower_median"), "n")


@query("g04_ratings", """
SELECT l_suppkey, count(*) AS n, floor(avg(CASE WHEN l_quantity < 40 THEN l_quantity END) * 10 + 0.5) / 10 AS rating,
CAST(floor(100 * avg(CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 0 END) + 0.5) AS BIGINT) AS returned FROM lineitem GROUP BY l_suppkey""")  # fmt: skip
def g04(t: Tables) -> DataFrame:
    flag = F.when(F.col("l_returnflag") == "R", True).when(F.col("l_returnflag") == "A", False)
    known = F.when(F.col("l_quantity") < 40, F.col("l_quantity"))
    return t.lineitem.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), A.rating(known).alias("rating"), A.per_cent(flag).alias("returned"))


@query("g05_key_or_slug", r"SELECT coalesce(nullif(CASE WHEN p_size > 25 THEN p_name ELSE '' END, ''), trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-')) AS slug, count(*) AS n FROM part GROUP BY 1")
def g05(t: Tables) -> DataFrame:
    slug = F.trim(F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]+", "-"), F.lit("-"))
    own = F.nullif(F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(""), F.lit(""))
    return t.part.groupBy(F.coalesce(own, slug).alias("slug")).agg(F.count(F.lit(1)).alias("n"))


@query("g06_conditional_counts", "SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_totalprice > 100000) AS large FROM orders")
def g06(t: Tables) -> DataFrame:
    return A.conditional_counts(t.orders, {"filled": F.col("o_orderstatus") == "F", "open": F.col("o_orderstatus") == "O", "large": F.col("o_totalprice") > 100000})


@query("g07_facets", """
WITH o AS (SELECT o_orderstatus, o_orderpriority, c_mktsegment, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n, CAST(sum(c) AS BIGINT) AS total FROM o GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), CAST(sum(c) AS BIGINT) FROM o GROUP BY 2
UNION ALL SELECT 'c_mktsegment', c_mktsegment, count(*), CAST(sum(c) AS BIGINT) FROM o GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*), CAST(sum(c) AS BIGINT) FROM o""")  # fmt: skip
def g07(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).withColumn("c", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return A.facets(rows, ["o_orderstatus", "o_orderpriority", "c_mktsegment"], "c")


@query("g08_distinct_lists", "SELECT string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS kinds, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part")
def g08(t: Tables) -> DataFrame:
    return t.part.agg(*[F.array_join(F.array_sort(F.collect_set(c)), ",").alias(name) for c, name in (("p_type", "kinds"), ("p_brand", "brands"))])


@query("g10_directory", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source ORDER BY n DESC, lang, source LIMIT 20")
def g10(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang", "source").limit(20)


@query("g11_event_summary", f"""
SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT user_id) FILTER (WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS users_7d,
count(DISTINCT user_id) FILTER (WHERE ts >= TIMESTAMP '2024-01-30') AS users_today, count(*) FILTER (WHERE event_type = 'view') AS views FROM events""")  # fmt: skip
def g11(t: Tables) -> DataFrame:
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    user = F.col("user_id")
    return t.events.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(user).alias("users"), F.count_distinct(F.when(F.col("ts") >= at(NOW) - F.expr("INTERVAL 7 DAYS"), user)).alias("users_7d"),
        F.count_distinct(F.when(F.col("ts") >= at("2024-01-30"), user)).alias("users_today"), F.count_if(F.col("event_type") == "view").alias("views"),
    )


@query("g11_top_sources", "SELECT coalesce(nullif(CASE WHEN user_id % 4 = 0 THEN '' ELSE event_type END, ''), 'Direct') AS source, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, source LIMIT 8")
def g11b(t: Tables) -> DataFrame:
    source = F.coalesce(F.nullif(F.when(F.col("user_id") % 4 == 0, "").otherwise(F.col("event_type")), F.lit("")), F.lit("Direct"))
    return t.events.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "source").limit(8)


@query("g12_rates", """
WITH c AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS bought FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN views > 0 THEN floor(bought * 1000 / views * 10 + 0.5) / 10 END AS per_1000 FROM c""")  # fmt: skip
def g12(t: Tables) -> DataFrame:
    counted = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("views"), F.count_if(F.col("event_type") == "purchase").alias("bought"))
    return counted.select("user_id", A.rate(F.col("bought"), F.col("views"), 1000, 1).alias("per_1000"))


@query("g13_outcomes_by_source", """
SELECT source, count(*) AS items, count(*) FILTER (WHERE n_chars < 300) AS short, count(*) FILTER (WHERE n_chars >= 300 AND lang <> 'en') AS language, count(*) FILTER (WHERE n_chars >= 300 AND lang = 'en') AS accepted FROM documents GROUP BY source""")  # fmt: skip
def g13(t: Tables) -> DataFrame:
    reason = F.when(F.col("n_chars") < 300, "short").when(F.col("lang") != "en", "language").otherwise("accepted")
    tests = {name: F.col("reason") == name for name in ("short", "language", "accepted")}
    return t.documents.withColumn("reason", reason).groupBy("source").agg(F.count(F.lit(1)).alias("items"), *[F.count_if(x).alias(n) for n, x in tests.items()])


@query("g15_batch_state", """
SELECT l_orderkey, CASE WHEN bool_or(l_linestatus = 'O') THEN 'processing' WHEN bool_or(l_returnflag = 'R') THEN 'partial' ELSE 'done' END AS state FROM lineitem GROUP BY l_orderkey""")  # fmt: skip
def g15(t: Tables) -> DataFrame:
    states = [("processing", F.bool_or(F.col("l_linestatus") == "O")), ("partial", F.bool_or(F.col("l_returnflag") == "R"))]
    return t.lineitem.groupBy("l_orderkey").agg(A.rolled_up(states, "done").alias("state"))


@query("g16_ledger_state", """
WITH l AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'sent' WHEN 'N' THEN 'failed' ELSE CASE WHEN l_linenumber > 5 THEN 'publishing' ELSE 'sent' END END AS s, l_linestatus = 'O' AND l_quantity > 45 AS test FROM lineitem)
SELECT l_orderkey, CASE WHEN coalesce(bool_or(s = 'publishing') FILTER (WHERE NOT test), false) THEN 'publishing' WHEN coalesce(bool_and(s = 'sent') FILTER (WHERE NOT test), false) THEN 'published'
WHEN coalesce(bool_or(s = 'sent') FILTER (WHERE NOT test), false) THEN 'partial' ELSE 'approved' END AS state FROM l GROUP BY l_orderkey""")  # fmt: skip
def g16(t: Tables) -> DataFrame:
    s = F.when(F.col("l_returnflag") == "A", "sent").when(F.col("l_returnflag") == "N", "failed").when(F.col("l_linenumber") > 5, "publishing").otherwise("sent")
    real = F.when(~((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 45)), s)
    rows = t.lineitem.select("l_orderkey", real.alias("s"))
    states = [("publishing", F.bool_or(F.col("s") == "publishing")), ("published", F.bool_and(F.col("s") == "sent")), ("partial", F.bool_or(F.col("s") == "sent"))]
    return rows.groupBy("l_orderkey").agg(A.rolled_up(states, "approved").alias("state"))


@query("g17_strongest_and_first", """
SELECT l_orderkey, CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') = count(*) THEN 'all' WHEN count(*) FILTER (WHERE l_returnflag = 'R') > 0 THEN 'some' ELSE 'none' END AS returned,
min(CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS strongest, arg_min(l_partkey, l_linenumber * 100000000 + l_partkey) FILTER (WHERE l_returnflag = 'A') AS first_part FROM lineitem GROUP BY l_orderkey""")  # fmt: skip
def g17(t: Tables) -> DataFrame:
    n = F.count_if(F.col("l_returnflag") == "R")
    level = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    first = F.min_by("l_partkey", F.when(F.col("l_returnflag") == "A", F.col("l_linenumber") * F.lit(100000000).cast("bigint") + F.col("l_partkey")))
    return t.lineitem.groupBy("l_orderkey").agg(A.rolled_up([("all", n == F.count(F.lit(1))), ("some", n > 0)], "none").alias("returned"), F.min(level).alias("strongest"), first.alias("first_part"))


@query("g20_stacked_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'events', count(*) FROM events")
def g20(t: Tables) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in (("orders", t.orders), ("customers", t.customer), ("events", t.events))]
    return reduce(DataFrame.unionByName, parts)


@query("g21_duplicated", "SELECT lower(p_name) || '|' || p_brand AS k, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def g21(t: Tables) -> DataFrame:
    return A.duplicated(t.part, F.concat_ws("|", F.lower("p_name"), "p_brand"), "k")


@query("g22_staleness", f"""
SELECT event_type, floor(date_diff('second', max(ts), TIMESTAMP '{NOW}') / 3600 * 10 + 0.5) / 10 AS hours,
CASE WHEN date_diff('second', max(ts), TIMESTAMP '{NOW}') > 12 * 3600 THEN 'stalled' WHEN date_diff('second', max(ts), TIMESTAMP '{NOW}') > 6 * 3600 THEN 'late' ELSE 'ok' END AS state FROM events GROUP BY event_type""")  # fmt: skip
def g22(t: Tables) -> DataFrame:
    latest = t.events.groupBy("event_type").agg(F.date_trunc("second", F.max("ts")).cast("timestamp_ntz").alias("at"))
    seconds = F.timestamp_diff("SECOND", F.col("at"), F.lit(NOW).cast("timestamp_ntz"))
    state = F.when(seconds > 12 * 3600, "stalled").when(seconds > 6 * 3600, "late").otherwise("ok")
    return latest.select("event_type", A.half_up(seconds / 3600, 1).alias("hours"), state.alias("state"))


@query("w01_keep_first", r"SELECT page_id FROM pages QUALIFY row_number() OVER (PARTITION BY regexp_replace(url, '[?#].*$', '') ORDER BY page_id) = 1")
def w01(t: Tables) -> DataFrame:
    return O.keep_first(t.pages, [F.regexp_replace("url", r"[?#].*$", "")], [F.col("page_id")]).select("page_id")


@query("w03_blocks", "SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM conversations")
def w03(t: Tables) -> DataFrame:
    return O.blocks(t.conversations, ["conv_id"], ["turn", "role"], F.col("role") == "user").select("conv_id", "turn", "block")


@query("w05_rotating_slice", "SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 12 OFFSET (SELECT CAST(7 % ceil(count(*) / 12) * 12 AS BIGINT) FROM supplier)")
def w05(t: Tables) -> DataFrame:
    return O.rotating(t.supplier.select("s_suppkey"), [F.col("s_suppkey")], t.supplier.count(), 7, 12)


@query("w06_most_recent", """
WITH d AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, event_id FROM d QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 6""")  # fmt: skip
def w06(t: Tables) -> DataFrame:
    latest = O.keep_first(t.events, ["user_id", "event_type", "props"], [F.col("ts").desc(), F.col("event_id").desc()])
    return O.most_recent(latest, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 6).select("user_id", "event_id")


@query("w07_transitions", """
SELECT event_id, previous FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events)
WHERE event_type = 'purchase' AND previous <> 'purchase'""")  # fmt: skip
def w07(t: Tables) -> DataFrame:
    return O.transitions(t.events, ["user_id"], ["ts", "event_id"], "event_type", "purchase").select("event_id", "previous")


@query("w09_stalest_first", "SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier ORDER BY k ASC NULLS FIRST, s_suppkey LIMIT 25")
def w09(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", F.nullif("s_nationkey", F.lit(3)).alias("k")).orderBy(F.col("k").asc_nulls_first(), "s_suppkey").limit(25)


@query("u01_tagged_union", "SELECT 'customer' AS origin, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier")
def u01(t: Tables) -> DataFrame:
    a = t.customer.select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u03_difference", "SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9500 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def u03(t: Tables) -> DataFrame:
    return t.customer.where("c_acctbal > 9500").select(F.col("c_nationkey").alias("nation")).subtract(t.supplier.where("s_acctbal > 5000").select("s_nationkey"))


@query("u04_union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def u04(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("nation")).union(t.supplier.select("s_nationkey")).distinct()


@query("u05_shared_words", "SELECT doc_id, CAST(len(list_intersect(list_distinct(string_split(lower(text), ' ')), ['the', 'of', 'and', 'le', 'de', 'der'])) AS INTEGER) AS n FROM documents")
def u05(t: Tables) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("the", "of", "and", "le", "de", "der")])
    return t.documents.select("doc_id", F.size(F.array_intersect(F.split(F.lower("text"), " "), words)).alias("n"))

"""Queries of standing alerts, rate limits, horizons and rows kept apart by their time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import alerts, duplicates, horizons, limits, related
from tessera.plans.registry import Tables, query
from tessera.streaming import apart


@query("r10_alert_index", r"""
WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
a AS (SELECT item_id, ['all', 'private', 'government'][item_id % 3 + 1] AS kind, [lower(w[2] || ' ' || w[3]), lower(w[5]), lower(w[9])] AS keywords, CASE WHEN item_id % 2 = 0 THEN [lower(w[7])] ELSE [] END AS fields FROM w),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS hay, source IN ('src0', 'src1', 'src2') AS public FROM documents)
SELECT item_id, doc_id FROM a JOIN d ON (kind = 'all' OR (kind = 'government') = public) AND len(list_filter(keywords, lambda k: contains(hay, k))) > 0 AND len(list_filter(fields, lambda f: NOT contains(hay, f))) = 0""")  # fmt: skip
def r10_index(t: Tables) -> DataFrame:
    """An alert made of each benchmark item: any of three of its words, for half of them another as well; every document is a listing."""
    w, k = F.split("text", " "), F.col("item_id")
    keywords = F.array(F.concat_ws(" ", F.get(w, F.lit(1)), F.get(w, F.lit(2))), F.get(w, F.lit(4)), F.get(w, F.lit(8)))
    fields = F.when(k % 2 == 0, F.array(F.get(w, F.lit(6)))).otherwise(F.array().cast("array<string>"))
    kind = F.get(F.array(F.lit("all"), F.lit("private"), F.lit("government")), (k % 3).cast("int"))
    made = t.benchmark.select("item_id", kind.alias("kind"), keywords.alias("keywords"), fields.alias("fields"))
    sector = F.when(F.col("source").isin("src0", "src1", "src2"), "Government").otherwise("Private")
    return alerts.matches(made, t.documents, "item_id", "doc_id", "text", alerts.sector_gate(F.col("kind"), sector))


@query("o03_rate_limit", """
WITH RECURSIVE s AS (SELECT user_id, min(ts) AS s FROM events GROUP BY user_id
    UNION ALL SELECT e.user_id, min(e.ts) FROM s JOIN events e ON e.user_id = s.user_id AND e.ts > s.s + INTERVAL 1 DAY GROUP BY e.user_id),
w AS (SELECT event_id, e.user_id, e.ts, max(s.s) AS s FROM events e JOIN s ON e.user_id = s.user_id AND s.s <= e.ts GROUP BY event_id, e.user_id, e.ts)
SELECT event_id, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) <= 2 AS allowed FROM w""")  # fmt: skip
def o03(t: Tables) -> DataFrame:
    """Two events of a user in a day that begins with the first of them."""
    return limits.first_hit_limit(t.events, "user_id", "ts", "event_id", 86_400, 2).select("event_id", "allowed")


@query("o04_sliding", """
WITH d AS (SELECT unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM events), DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day), h AS (SELECT unnest([1, 2, 7, 30]) AS horizon)
SELECT day, CAST(horizon AS INTEGER) AS horizon, count(event_id) AS n, count(DISTINCT user_id) AS keys FROM d CROSS JOIN h
LEFT JOIN events ON CAST(ts AS DATE) <= day AND CAST(ts AS DATE) > day - horizon GROUP BY ALL""")  # fmt: skip
def o04(t: Tables) -> DataFrame:
    return horizons.sliding(t.events, F.to_date("ts"), "user_id", [1, 2, 7, 30], F.lit("2024-01-31").cast("date"))


@query("o05_apart", """
WITH l AS (SELECT l_orderkey % 24 AS run, CASE WHEN l_linenumber % 10 <> 7 THEN CAST(l_shipdate AS TIMESTAMP) END AS moment FROM lineitem),
m AS (SELECT run, max(moment) FILTER (WHERE moment BETWEEN TIMESTAMP '1997-06-01' - INTERVAL 1000 DAY AND TIMESTAMP '1997-06-01' + INTERVAL 2 HOUR) AS newest FROM l GROUP BY run),
s AS (SELECT run, max(newest) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM m)
SELECT run, CASE WHEN moment IS NULL THEN 'undated' WHEN moment > TIMESTAMP '1997-06-01' + INTERVAL 2 HOUR THEN 'future' WHEN moment < TIMESTAMP '1997-06-01' - INTERVAL 1000 DAY THEN 'too_old'
    WHEN moment < seen - INTERVAL 300 DAY THEN 'late' ELSE 'in_time' END AS side, count(*) AS n FROM l JOIN s USING (run) GROUP BY ALL""")  # fmt: skip
def o05(t: Tables) -> DataFrame:
    """Lines as if they came in 24 runs: which are in time, late, too old, from the future or without a time."""
    at = F.when(F.col("l_linenumber") % 10 != 7, F.col("l_shipdate").cast("timestamp"))
    lines = t.lineitem.select((F.col("l_orderkey") % 24).alias("run"), at.alias("at"))
    now, ahead, oldest = F.lit("1997-06-01").cast("timestamp"), "2 hours", "1000 days"
    dated = apart.side(F.col("at"), now, F.lit(None).cast("timestamp"), "300 days", ahead, oldest) == "in_time"
    newest = lines.groupBy("run").agg(F.max(F.when(dated, F.col("at"))).alias("newest"))  # a row a run
    seen = newest.select("run", F.max("newest").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)).alias("seen"))
    sides = lines.join(seen, "run").withColumn("side", apart.side(F.col("at"), now, F.col("seen"), "300 days", ahead, oldest))
    return sides.groupBy("run", "side").agg(F.count(F.lit(1)).alias("n"))


@query("j09_fuzzy_best", r"""
WITH w AS (SELECT p_partkey AS id, p_brand || '-' || p_size AS email, regexp_replace(CAST(CAST(floor(p_retailprice) AS BIGINT) // 3 AS VARCHAR), '\D', '', 'g') AS phone, p_type || p_size AS url, lower(p_brand) AS company, lower(p_type) AS city,
    list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+'), lambda x: length(x) > 2)) AS title,
    list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_size || ' xx' || p_partkey % 50), '[^\p{L}\p{N}]+'), lambda x: length(x) > 2)) AS description FROM part),
s AS (SELECT a.id AS id, b.id AS other, least(100, CASE WHEN a.email = b.email THEN 35 ELSE 0 END + CASE WHEN a.phone = b.phone THEN 30 ELSE 0 END + CASE WHEN a.url = b.url THEN 35 ELSE 0 END + CASE WHEN a.company = b.company THEN 30 ELSE 0 END
    + CASE WHEN len(list_intersect(a.title, b.title)) * 100 >= 70 * len(list_distinct(a.title || b.title)) THEN 20 ELSE 0 END + CASE WHEN a.city = b.city THEN 10 ELSE 0 END
    + CASE WHEN len(list_intersect(a.description, b.description)) * 100 >= 50 * len(list_distinct(a.description || b.description)) THEN 20 ELSE 0 END) AS cents FROM w a JOIN w b ON a.id <> b.id)
SELECT id AS p_partkey, other, cents / 100.0 AS score FROM s WHERE cents >= 50 QUALIFY row_number() OVER (PARTITION BY id ORDER BY cents DESC, other) = 1""")  # fmt: skip
def j09_fuzzy(t: Tables) -> DataFrame:
    """The part that is most like each part by seven kinds of evidence, made of the part's columns."""
    size = F.col("p_size").cast("string")
    said = F.concat_ws(" ", "p_name", "p_type", "p_brand", size, F.concat(F.lit("xx"), (F.col("p_partkey") % 50).cast("string")))
    fields = {
        "email": F.concat_ws("-", "p_brand", size), "phone": F.floor(F.col("p_retailprice").cast("bigint") / 3), "url": F.concat("p_type", size),
        "company": F.col("p_brand"), "title": F.col("p_name"), "city": F.col("p_type"), "description": said,
    }
    return duplicates.fuzzy_duplicates(t.part, "p_partkey", fields, 1).select("p_partkey", "other", "score")


@query("r05_related_all", r"""
WITH l AS (SELECT p_partkey AS id, lower(p_name) AS title, [lower(p_type), split_part(lower(p_name), ' ', 2), 'brand ' || split_part(p_brand, '#', 2)] AS skills, lower(p_name || ' ' || p_type || ' brand ' || split_part(p_brand, '#', 2)) AS said,
    'city' || p_size % 20 AS place, p_brand AS sector, p_partkey % 3 = 0 AS featured FROM part),
s AS (SELECT a.id, b.id AS other, CASE WHEN len(list_filter(string_split(a.title, ' '), lambda w: length(w) > 3 AND contains(b.title, w))) > 0 THEN 35 ELSE 0 END + least(30, 10 * len(list_filter(list_distinct(a.skills), lambda k: k <> '' AND contains(b.said, k))))
    + CASE WHEN contains(b.place, a.place) THEN 20 ELSE 0 END + CASE WHEN a.sector = b.sector THEN 8 ELSE 0 END + CASE WHEN b.featured THEN 2 ELSE 0 END AS score FROM l a JOIN l b ON a.id <> b.id)
SELECT id AS p_partkey, other, CAST(score AS INTEGER) AS score FROM s WHERE score >= 25 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= 4""")  # fmt: skip
def r05_all(t: Tables) -> DataFrame:
    """Four related parts for each part: words of its name, its kind and brand as skills, a size group as place."""
    brand = F.concat(F.lit("brand "), F.get(F.split("p_brand", "#"), F.lit(1)))
    skills = F.array(F.col("p_type"), F.get(F.split("p_name", " "), F.lit(1)), brand)
    place = F.concat(F.lit("city"), (F.col("p_size") % 20).cast("string"))
    return related.related(t.part, "p_partkey", F.col("p_name"), skills, F.concat_ws(" ", "p_name", "p_type", brand), place, F.col("p_brand"), F.col("p_partkey") % 3 == 0)

"""Queries of sinks, scores, caps, leases and the smaller forms of lists, counts and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.operators import ordering as O  # noqa: E741
from tessera.operators import scores, sinks
from tessera.operators.tables import held
from tessera.plans.registry import NOW, Tables, query
from tessera.streaming import jobs


@query("k02_upsert", """
WITH i AS (SELECT o_custkey AS id, CAST(count(*) AS DOUBLE) AS payload FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS id, c_acctbal AS payload FROM customer WHERE c_custkey NOT IN (SELECT id FROM i) UNION ALL SELECT * FROM i""")  # fmt: skip
def k02(t: Tables) -> DataFrame:
    stored = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("payload"))
    incoming = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("payload"))
    return sinks.upserted(stored, incoming, ["id"])


@query("k03_transitions", """
WITH a AS (SELECT l_orderkey, max(l_returnflag) AS action FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE action WHEN 'A' THEN 'approved' WHEN 'R' THEN 'rejected' ELSE o_orderstatus END AS state FROM orders LEFT JOIN a ON l_orderkey = o_orderkey""")  # fmt: skip
def k03(t: Tables) -> DataFrame:
    actions = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_returnflag").alias("action"))
    return sinks.moved(t.orders.select("o_orderkey", F.col("o_orderstatus").alias("state")), actions, "o_orderkey", "action", "state", {"A": "approved", "R": "rejected"})


@query("k04_soft_delete", """
SELECT p_partkey, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') THEN 'Deleted' ELSE 'Live' END AS state,
p_size > 10 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') AS published FROM part""")  # fmt: skip
def k04(t: Tables) -> DataFrame:
    stored = t.part.select("p_partkey", F.lit("Live").alias("state"), (F.col("p_size") > 10).alias("published"))
    return sinks.soft_deleted(stored, t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "state", "published")


@query("o09_changed", """
SELECT n.doc_id FROM (SELECT doc_id, CASE WHEN n_chars > 2000 THEN lang ELSE nullif(source, 'src1') END AS v, n_chars FROM documents) n
JOIN (SELECT doc_id, lang AS v, n_chars FROM documents) o USING (doc_id) WHERE coalesce(n.v, '') <> coalesce(o.v, '')""")  # fmt: skip
def o09(t: Tables) -> DataFrame:
    stored = t.documents.select("doc_id", F.col("lang").alias("v"), "n_chars")
    value = F.when(F.col("n_chars") > 2000, F.col("lang")).otherwise(F.nullif("source", F.lit("src1")))
    return sinks.changed(stored, t.documents.select("doc_id", value.alias("v"), "n_chars"), "doc_id", ["v", "n_chars"]).select("doc_id")


@query("o11_daily_cap", f"""
WITH n AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS k FROM events)
SELECT event_id FROM n WHERE k <= CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END AND ts < TIMESTAMP '{NOW}'""")  # fmt: skip
def o11(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("user_id", "event_type", F.to_date("ts")).orderBy("ts", "event_id"))
    cap = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2).otherwise(3)
    return t.events.withColumn("k", k).where((F.col("k") <= cap) & (F.col("ts") < F.lit(NOW).cast("timestamp_ntz"))).select("event_id")


@query("t09_lease", f"""
SELECT event_id, CASE WHEN event_type <> 'click' THEN 'done' WHEN epoch_ms(TIMESTAMP '{NOW}') - epoch_ms(ts) > 15 * 86400000 THEN 'uncertain' ELSE 'publishing' END AS state FROM events""")  # fmt: skip
def t09(t: Tables) -> DataFrame:
    age = F.timestamp_diff("MILLISECOND", F.col("ts"), F.lit(NOW).cast("timestamp_ntz"))
    state = F.when(F.col("event_type") != "click", "done").when(age > 15 * 86_400_000, "uncertain").otherwise("publishing")
    return t.events.select("event_id", state.alias("state"))


@query("t06_closing_soon", "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND BETWEEN TIMESTAMP '1997-03-01 09:00:00' AND TIMESTAMP '1997-03-08 09:00:00'")
def t06(t: Tables) -> DataFrame:
    now = F.lit("1997-03-01 09:00:00").cast("timestamp_ntz")
    end = F.to_date("o_orderdate").cast("timestamp_ntz") + F.expr("INTERVAL '1' DAY - INTERVAL '0.001' SECOND")
    return t.orders.where(end.between(now, now + F.expr("INTERVAL 7 DAYS"))).select("o_orderkey")


@query("t07_backfill", "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 90 DAY END, o_orderdate + INTERVAL 1 DAY) AS expires FROM orders")
def t07(t: Tables) -> DataFrame:
    own = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 90 DAYS"))
    return t.orders.select("o_orderkey", F.coalesce(own, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("expires"))


@query("t10_next_delay", "SELECT p_partkey, least(30000, p_size * 1000 * 1.8)::DOUBLE AS delay FROM part")
def t10(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.least(F.lit(30000.0), F.col("p_size") * 1000 * F.lit(1.8)).alias("delay"))


@query("w02_best_match", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount * 10 >= 0.5 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_linenumber) = 1""")  # fmt: skip
def w02(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_discount * 10 >= 0.5")
    return O.keep_first(rows, ["l_orderkey"], [F.col("l_discount").desc(), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber")


@query("w04_nearest_heading", """
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS pos FROM documents)
SELECT doc_id, pos, last_value(CASE WHEN length(line) < 15 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM x""")  # fmt: skip
def w04(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("doc_id", "pos", F.last(F.when(F.char_length("line") < 15, F.col("line")), ignorenulls=True).over(before).alias("heading"))


@query("w08_longest_rule", r"""
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('/en/', FALSE), ('/en/a', TRUE), ('/fr', FALSE), ('/', TRUE)) AS v (prefix, ok)),
m AS (SELECT page_id, ok, length(prefix) AS n FROM p JOIN r ON starts_with(path, prefix))
SELECT page_id, coalesce(arg_max(ok, n), TRUE) AS allowed FROM p LEFT JOIN m USING (page_id) GROUP BY page_id""")  # fmt: skip
def w08(t: Tables) -> DataFrame:
    path = F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1)
    return t.pages.select("page_id", scores.longest_rule(path, [("/en/", False), ("/en/a", True), ("/fr", False), ("/", True)]).alias("allowed"))


@query("r01_duplicate_score", """
WITH w AS (SELECT *, list_distinct(string_split(lower(p_name), ' ')) AS ws FROM part),
p AS (SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_type = b.p_type AS company, a.p_size = b.p_size AS city,
      len(list_intersect(a.ws, b.ws)) / len(list_distinct(a.ws || b.ws)) >= 0.7 AS title FROM w a JOIN w b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey)
SELECT a, b, (CASE WHEN company THEN 30 ELSE 0 END + CASE WHEN title THEN 20 ELSE 0 END + CASE WHEN city THEN 10 ELSE 0 END) / 100 AS score,
concat_ws(',', CASE WHEN company THEN 'company' END, CASE WHEN title THEN 'title' END, CASE WHEN city THEN 'city' END) AS reasons FROM p""")  # fmt: skip
def r01(t: Tables) -> DataFrame:
    """Distinct names of a brand and type are compared once; each part knows the numbers of names like its own, so that a pair is two comparisons."""
    block = ["p_brand", "p_type"]
    names = t.part.select(*block, "p_name", F.array_distinct(F.split(F.lower("p_name"), " ")).alias("ws")).distinct()
    names = held(names.withColumn("name", F.monotonically_increasing_id()))
    other = names.select(*block, F.col("name").alias("like"), F.col("ws").alias("other_ws"))
    alike = J.dealt(names.drop("p_name"), other, block).where(scores.jaccard(F.col("ws"), F.col("other_ws")) >= 0.7)
    alike = names.select(*block, "p_name", "name").join(alike.groupBy("name").agg(F.collect_set("like").alias("likes")).hint("merge"), "name", "left")
    rows = held(t.part.join(alike.hint("merge"), [*block, "p_name"], "left").select(*block, "p_partkey", "p_size", "name", "likes"))
    a = rows.select(*block, F.col("p_partkey").alias("a"), F.col("p_size").alias("a_size"), "likes")
    b = rows.select(*block, F.col("p_partkey").alias("b"), F.col("p_size").alias("b_size"), F.col("name").alias("b_name"))
    pairs = J.in_pieces(a, b, block).where(F.col("a") < F.element_at("_piece", -1)["b"])  # pieces are sorted by b
    pairs = pairs.select("a", "a_size", "likes", F.inline("_piece")).where("a < b")
    title, city = F.coalesce(F.array_contains("likes", F.col("b_name")), F.lit(False)), F.coalesce(F.col("a_size") == F.col("b_size"), F.lit(False))
    # four outcomes at most, each made once
    said = {(x, y): scores.weighted([("company", 0.30, F.lit(True)), ("title", 0.20, F.lit(x)), ("city", 0.10, F.lit(y))]) for x in (True, False) for y in (True, False)}
    pick = lambda f: F.when(title & city, f(*said[True, True])).when(title, f(*said[True, False])).when(city, f(*said[False, True])).otherwise(f(*said[False, False]))
    return pairs.select("a", "b", pick(lambda score, _: score).alias("score"), pick(lambda _, reasons: F.array_join(reasons, ",")).alias("reasons"))


@query("j10_two_step_lookup", """
WITH u AS (SELECT p_type, min(p_partkey) AS k FROM part WHERE p_size > 30 GROUP BY 1), n AS (SELECT lower(p_name || ' ' || p_brand) AS x, min(p_partkey) AS k FROM part WHERE p_size > 30 GROUP BY 1)
SELECT p_partkey, coalesce(CASE WHEN p_size < 5 THEN u.k END, n.k) AS found FROM part LEFT JOIN u USING (p_type) LEFT JOIN n ON n.x = lower(p_name || ' ' || p_brand)""")  # fmt: skip
def j10(t: Tables) -> DataFrame:
    stored = t.part.where("p_size > 30")
    name = F.lower(F.concat_ws(" ", "p_name", "p_brand"))
    by_link = stored.groupBy("p_type").agg(F.min("p_partkey").alias("u"))
    by_name = stored.groupBy(name.alias("x")).agg(F.min("p_partkey").alias("n"))
    rows = t.part.withColumn("x", name).join(by_link, "p_type", "left").join(by_name, "x", "left")
    return rows.select("p_partkey", F.coalesce(F.when(F.col("p_size") < 5, F.col("u")), F.col("n")).alias("found"))


@query("u02_union_all", "SELECT 'customer' AS of, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part")
def u02(t: Tables) -> DataFrame:
    one = lambda name: getattr(t, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("of"), "n")
    return one("customer").union(one("supplier")).union(one("part"))


@query("u06_distinct_sliced", "SELECT p_partkey, array_to_string(list_distinct(list_filter([p_name, nullif(p_brand, 'Brand#1'), p_name], lambda x: x IS NOT NULL)).list_sort()[1:2], '|') AS kept FROM part")
def u06(t: Tables) -> DataFrame:
    found = F.array_compact(F.array("p_name", F.nullif("p_brand", F.lit("Brand#1")), "p_name"))
    return t.part.select("p_partkey", F.array_join(F.slice(F.sort_array(F.array_distinct(found)), 1, 2), "|").alias("kept"))


@query("y02_trimmed_list", "SELECT p_partkey, CAST(len(list_distinct([trim(x) FOR x IN string_split(p_name || ' , ' || p_type || ', ' || p_name, ',') IF trim(x) <> ''])) AS INTEGER) AS n FROM part")
def y02(t: Tables) -> DataFrame:
    parts = F.split(F.concat("p_name", F.lit(" , "), "p_type", F.lit(", "), "p_name"), ",")
    return t.part.select("p_partkey", F.size(F.slice(F.array_distinct(F.filter(F.transform(parts, lambda x: F.btrim(x)), lambda x: x != "")), 1, 20)).alias("n"))


@query("y04_loose_json", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def y04(t: Tables) -> DataFrame:
    fenced = F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))
    return t.events.select("event_id", F.get_json_object(F.regexp_extract(fenced, r"(?s)(\{.*\})", 1), "$.k").cast("bigint").alias("k"))


@query("g14_run_totals", "SELECT count(*) AS found, count(*) FILTER (WHERE event_type = 'purchase') AS staged, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events")
def g14(t: Tables) -> DataFrame:
    return t.events.agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("event_type") == "purchase").alias("staged"), F.count_if(F.col("event_type") == "error").alias("errors"))


@query("g19_daily_attempts", "SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15 18:30:00') AS attempts FROM events GROUP BY 1")
def g19(t: Tables) -> DataFrame:
    start = F.lit("2024-01-15 18:30:00").cast("timestamp_ntz")
    return t.events.groupBy("event_type").agg(F.count_if(F.col("ts") >= start).alias("attempts"))


@query("g23_option_counts", "SELECT lang, lang || ' (' || count(*) || ')' AS label, count(*) AS n FROM documents GROUP BY lang ORDER BY lang")
def g23(t: Tables) -> DataFrame:
    counted = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("lang", F.concat("lang", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("label"), "n").orderBy("lang")


@query("f19_known_place", "SELECT doc_id FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL AND lang = 'en'")
def f19(t: Tables) -> DataFrame:
    return t.documents.where(F.col("lang").isNotNull() & F.col("source").isNotNull() & (F.col("lang") == "en")).select("doc_id")


@query("s01_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 40")
def s01(t: Tables) -> DataFrame:
    rows = t.orders.where("o_orderstatus = 'F' AND o_totalprice > 100000").select("o_orderkey", "o_totalprice")
    return rows.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(40)


@query("x09_fingerprints", "SELECT p_partkey, lower(trim(p_name)) || '|' || lower(trim(p_brand)) || '|' || lower(trim(p_type)) AS fingerprint FROM part")
def x09(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat_ws("|", *[F.lower(F.btrim(c)) for c in ("p_name", "p_brand", "p_type")]).alias("fingerprint"))


@query("e16_experience_range", "SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN 0 ELSE p_size END AS INTEGER) AS least, CAST(CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN p_size + 3 ELSE p_size + 9 END AS INTEGER) AS most FROM part")
def e16(t: Tables) -> DataFrame:
    k, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    line = F.when(k == 0, "Fresher").when(k == 1, F.concat(n, F.lit(" years"))).otherwise(F.concat(n, F.lit(" to "), (F.col("p_size") + 9).cast("string"), F.lit(" yrs")))
    found = F.regexp_extract_all(line, F.lit("([0-9]+)"), 1)
    low, high = F.get(found, F.lit(0)).cast("int"), F.get(found, F.lit(1)).cast("int")
    fresh = line.rlike("(?i)fresher")
    return t.part.select("p_partkey", F.when(fresh, 0).otherwise(low).alias("least"), F.when(fresh, 1).otherwise(F.coalesce(high, low + 3)).alias("most"))


@query("o15_sessions", """
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER u < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS is_new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")  # fmt: skip
def o15(t: Tables) -> DataFrame:
    return jobs.sessions(t.events, "user_id", "ts", "6 hours", "1 day")


@query("o04_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS begin, event_type, count(*) AS n, max(value) AS most FROM events GROUP BY 1, 2")
def o04(t: Tables) -> DataFrame:
    return jobs.windowed(t.events, "ts", "1 day", "2 days", ["event_type"], most=F.max("value"))

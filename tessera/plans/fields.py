"""Queries of fields, feeds, tables, structured data, labels and counts: texts are made from the tables' columns, the SQL gives what went in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fields as D
from tessera.operators import scores
from tessera.operators import states as S
from tessera.operators.tables import spread
from tessera.plans.registry import NOW, Tables, query
from tessera.sources import markup


def _said(key: str, of: int, *lines: str) -> Column:
    """One of several texts, by key modulo their number; names in braces are columns."""

    def made(line: str) -> Column:
        pieces = line.replace("}", "{").split("{")
        return F.concat(*[F.expr(f"string({p})") if i % 2 else F.lit(p) for i, p in enumerate(pieces)])

    k = F.col(key) % of
    chosen = F.when(k == 0, made(lines[0]))
    for i, line in enumerate(lines[1:], 1):
        chosen = chosen.when(k == i, made(line))
    return chosen


@query("e04_salary", """
SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN p_size * 1000 WHEN 1 THEN p_size * 100000 + 50000 WHEN 2 THEN p_size * 1000 WHEN 3 THEN p_size * 100000 WHEN 5 THEN p_size * 1000 END AS DOUBLE) AS least,
CAST(CASE p_partkey % 6 WHEN 0 THEN (p_size + 7) * 1000 WHEN 1 THEN (p_size + 3) * 100000 WHEN 5 THEN (p_size + 2) * 1000 END AS DOUBLE) AS most,
CASE p_partkey % 6 WHEN 2 THEN 'USD' WHEN 4 THEN NULL WHEN 5 THEN 'AED' ELSE 'INR' END AS currency, CASE p_partkey % 6 WHEN 0 THEN 'month' WHEN 1 THEN 'year' WHEN 3 THEN 'year' WHEN 5 THEN 'year' END AS period FROM part""")  # fmt: skip
def e04(t: Tables) -> DataFrame:
    lines = ("Site Engineer\nSalary: Rs. {p_size},000 - {p_size + 7},000 per month\nCall 5", "9 posts\nCTC {p_size}.5 to {p_size + 3} LPA", "We pay $ {p_size}k", "about {p_size} lakhs", "Salary: as per norms\n7 posts", "Package AED {p_size}-{p_size + 2}k per annum")
    return t.part.select("p_partkey", D.salary(_said("p_partkey", 6, *lines)).alias("s")).select("p_partkey", "s.*")


@query("e02_location", """
SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Pune' WHEN 1 THEN 'Chennai' WHEN 2 THEN 'Navi Mumbai' WHEN 3 THEN 'Pune' END AS city,
CASE c_custkey % 5 WHEN 0 THEN 'Maharashtra' WHEN 1 THEN 'Tamil Nadu' WHEN 2 THEN 'Maharashtra' WHEN 3 THEN 'Tamil Nadu' END AS state FROM customer""")  # fmt: skip
def e02b(t: Tables) -> DataFrame:
    places = {"Pune": "Maharashtra", "Navi Mumbai": "Maharashtra", "Chennai": "Tamil Nadu"}
    lines = ("{c_name}\nJob location: Pune - Maharashtra", "{c_name} is based in chennai, near the sea", "site at navi mumbai for {c_name}", "Location: Tamil Nadu | punes\nor pune", "Location: elsewhere {c_custkey}")
    return t.customer.select("c_custkey", D.location(_said("c_custkey", 5, *lines), places).alias("l")).select("c_custkey", "l.*")


@query("e06_company", """
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'Firm ' || s_suppkey || ' of Rome' WHEN 1 THEN 'Stone ' || s_suppkey || ' Infrastructure Pvt Ltd' WHEN 2 THEN 'North ' || s_suppkey || ' Builders' WHEN 3 THEN 'Gate ' || s_suppkey END AS company FROM supplier""")  # fmt: skip
def e06(t: Tables) -> DataFrame:
    text = _said("s_suppkey", 6, "Employer: Firm {s_suppkey} of Rome\nA Ltd", "Stone {s_suppkey} Infrastructure Pvt Ltd\nwants you", "North {s_suppkey} Builders\nwants you", "come", "Company: Acme", "Company: site engineer")
    title = _said("s_suppkey", 6, "Site engineer", "Planner", "Planner", "Planner at Gate {s_suppkey}", "Planner", "Site Engineer")
    return t.supplier.select("s_suppkey", D.company(text, title).alias("company"))


@query("e07_degree", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'B.E' WHEN 1 THEN 'Diploma' WHEN 2 THEN 'M.Tech' WHEN 3 THEN 'ITI' END AS degree,
CASE p_partkey % 6 WHEN 0 THEN 'Civil' WHEN 2 THEN 'Structural' WHEN 4 THEN 'Civil' END AS branch FROM part""")  # fmt: skip
def e07(t: Tables) -> DataFrame:
    text = _said("p_partkey", 6, "needs B.E. Civil, {p_size}", "Diploma {p_size}\ncivil", "M Tech (structural)", "ITI holders {p_size}", "any structural engineering", "no degree, {p_name}")
    return t.part.select("p_partkey", D.degree(text).alias("d")).select("p_partkey", "d.*")


@query("e11_deadline", """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 2 THEN 'relative_days' WHEN 3 THEN 'update_soon' WHEN 4 THEN 'notified_soon' ELSE 'fixed' END AS kind,
CASE WHEN o_orderkey % 6 < 2 THEN CAST(o_orderdate AS DATE) END AS day, CASE WHEN o_orderkey % 6 = 2 THEN CAST(day(o_orderdate) AS INTEGER) END AS days FROM orders""")  # fmt: skip
def e11(t: Tables) -> DataFrame:
    text = _said("o_orderkey", 6, "Last date: {date_format(o_orderdate, 'd/M/yyyy')} or within 5 days", " {date_format(o_orderdate, 'dd-MM-yyyy')} ", "Apply within {day(o_orderdate)} days", "Update  Soon", "to be notified soon", "1/1/2020 was a day")
    return t.orders.select("o_orderkey", D.deadline(text).alias("d")).select("o_orderkey", "d.*")


@query("e12_notice_number", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey || '/2024' WHEN 1 THEN 'CE-' || o_orderkey END AS number FROM orders")
def e12(t: Tables) -> DataFrame:
    text = _said("o_orderkey", 3, "Advt. No: {o_orderkey}/2024 out", "see notification #CE-{o_orderkey}, please", "order {o_orderkey}")
    return t.orders.select("o_orderkey", D.notice_number(F.regexp_replace(text, "No: ", "")).alias("number"))


@query("e19_video", """
SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN lpad(p_partkey::VARCHAR, 11, 'x') END AS id,
CASE WHEN n >= 3600 THEN n // 3600 || 'h ' || n % 3600 // 60 || 'm ' WHEN n >= 60 THEN n // 60 || 'm ' ELSE '' END || n % 60 || 's' AS length FROM (SELECT p_partkey, p_partkey * p_size AS n FROM part)""")  # fmt: skip
def e19(t: Tables) -> DataFrame:
    url = _said("p_partkey", 4, "https://youtu.be/{lpad(p_partkey, 11, 'x')}?t=1", "https://www.youtube.com/watch?a=1&v={lpad(p_partkey, 11, 'x')}&b=2", "https://www.youtube.com/embed/{lpad(p_partkey, 11, 'x')}", "https://example.org/{p_partkey}")
    return t.part.select("p_partkey", D.video_id(url).alias("id"), D.duration(F.col("p_partkey") * F.col("p_size")).alias("length"))


@query("c13_notice_kind", """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'result' WHEN 1 THEN 'admit_card' WHEN 2 THEN 'closing_date_changed' WHEN 3 THEN 'updated' WHEN 4 THEN 'new' ELSE 'other_update' END AS kind FROM part""")  # fmt: skip
def c13(t: Tables) -> DataFrame:
    text = _said("p_partkey", 6, "Recruitment {p_size}: final Result", "Hall ticket of vacancy {p_size}", "Date Extended, revised", "Revised vacancies", "{p_size} vacancies", "resulting {p_size} renewals")
    return t.part.select("p_partkey", D.by_words(D.NOTICE_KINDS, text, "other_update").alias("kind"))


@query("c15_run_state", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'refused' WHEN 'view' THEN 'running' ELSE 'unknown' END AS state, event_type IN ('purchase', 'error') AS ended FROM events")
def c15(t: Tables) -> DataFrame:
    known = {"purchase": "done", "error": "refused", "view": "running"}
    state = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), "event_type"), F.lit("unknown"))
    return t.events.select("event_id", state.alias("state"), state.isin("done", "refused").alias("ended"))


@query("c17_queue_state", """
SELECT p_partkey, CASE WHEN a IS NULL THEN 'NEW' WHEN a = 'A' THEN 'APPROVED' WHEN a = 'R' THEN 'REJECTED' ELSE 'QUEUED' END AS state FROM part LEFT JOIN (SELECT l_partkey, min(l_returnflag) AS a FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON l_partkey = p_partkey""")  # fmt: skip
def c17(t: Tables) -> DataFrame:
    queue = t.lineitem.where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_returnflag").alias("a"))
    state = F.when(F.col("a").isNull(), "NEW").when(F.col("a") == "A", "APPROVED").when(F.col("a") == "R", "REJECTED").otherwise("QUEUED")
    return t.part.join(queue, "p_partkey", "left").select("p_partkey", state.alias("state"))


@query("f22_content_errors", r"""
SELECT doc_id, concat_ws('; ', CASE WHEN trim(coalesce(lang, '')) IN ('', 'en') THEN 'title is required' END, CASE WHEN length(text) > 3000 THEN 'text exceeds 3000 characters' END,
CASE WHEN len(regexp_extract_all(text, '#[0-9A-Za-z_]+')) > 1 THEN 'text has ' || len(regexp_extract_all(text, '#[0-9A-Za-z_]+')) || ' hashtags (max 1)' END) AS errors FROM documents""")  # fmt: skip
def f22(t: Tables) -> DataFrame:
    rows = t.documents.withColumn("title", F.when(F.col("lang") == "en", " ").otherwise(F.col("lang")))
    return rows.select("doc_id", F.array_join(D.content_errors({"text": 3000}, "title", "text", 1), "; ").alias("errors"))


@query("f25_for_freshers", "SELECT p_partkey FROM part WHERE CASE p_partkey % 4 WHEN 0 THEN p_size <= 2 ELSE p_partkey % 4 < 3 END")
def f25(t: Tables) -> DataFrame:
    return t.part.where(D.for_freshers(_said("p_partkey", 4, "{p_size}+ years", "Freshers or 5 years", "nothing said", "10 - years of it"))).select("p_partkey")


@query("s02_feed_items", """
SELECT p_partkey, 0 AS pos, p_name || ' & <co' AS title, 'https://x.org/' || p_partkey AS link, p_type AS summary, p_size || ' Jan' AS published FROM part UNION ALL
SELECT p_partkey, 3, p_brand, 'https://y.org/' || p_partkey, NULL, '2024-01-0' || p_partkey % 9 FROM part""")  # fmt: skip
def s02(t: Tables) -> DataFrame:
    xml = (
        "<rss><item><title>{p_name} &amp;  &lt;co</title><link>https://x.org/{p_partkey}</link><description><![CDATA[<p>{p_type}</p>]]></description><pubDate>{p_size} Jan</pubDate></item>"
        "<item><title> </title><link>https://x.org</link></item><item><title>no link</title></item>"
        "<entry><title><![CDATA[{p_brand}]]></title><link rel='alternate' href=\"https://y.org/{p_partkey}\"/><updated>2024-01-0{p_partkey % 9}</updated></entry></rss>"
    )
    rows = spread(t.part, "p_partkey").select("p_partkey", _said("p_partkey", 1, xml).alias("xml"))
    return markup.feed_items(rows, "p_partkey", "xml")


@query("s07_table_rows", """
SELECT s_suppkey, i::INTEGER AS pos, CASE WHEN i = 0 THEN s_name END AS post, CASE WHEN i = 0 THEN CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey::VARCHAR END ELSE NULL END AS vacancies, CASE WHEN i = 0 THEN '/n/' || s_suppkey END AS link
FROM supplier, range(2) r (i)""")  # fmt: skip
def s07(t: Tables) -> DataFrame:
    html = _said(
        "s_suppkey",
        2,
        "<table class=x><tr><th>No.</th><th><b>Vacancies</b></th><th>Name of Post</th></tr><tr><td>1</td><td>{s_nationkey}</td><td><a href='/n/{s_suppkey}'>{s_name}</a></td></tr>\n<tr></tr></table>",
        "<TABLE><TR><TD>Post</TD></TR><TR><TD> <a href=\"/n/{s_suppkey}\">{s_name}</a>\n</TD></TR><TR></TR></TABLE>",
    )
    return markup.table_rows(t.supplier.select("s_suppkey", html.alias("html")), "s_suppkey", "html", {"post": r"\bpost\b", "vacancies": "vacanc"})


@query("s09_structured", """
SELECT s_suppkey, s_name AS title, CASE WHEN s_suppkey % 5 = 0 THEN 'Org ' || s_nationkey END AS org FROM supplier WHERE s_suppkey % 5 < 4""")  # fmt: skip
def s09(t: Tables) -> DataFrame:
    one = '"@type": "JobPosting", "title": "{s_name}"'
    bodies = (
        f'[{{"@type": "Thing"}}, {{{one}, "hiringOrganization": {{"name": "Org #s_nationkey#"}}}}]',
        f'{{"@graph": [{{"@type": "WebPage"}}, {{{one.replace(chr(34) + "JobPosting" + chr(34), "[" + chr(34) + "JobPosting" + chr(34) + "]")}}}]}}',
        f'{{"@type": "ItemList", "itemListElement": [{{"@type": "ListItem", "item": {{{one}}}}}]}}',
        f'/* jobs */ {{{one},}}',
        '{"@type": "JobPosting" broken',
    )
    page = lambda body: F.concat(F.lit('<html><script type="application/ld+json">'), body, F.lit("</script></html>"))
    made = [page(F.replace(F.replace(F.lit(b.replace("{s_name}", "#s_name#")), F.lit("#s_name#"), F.col("s_name")), F.lit("#s_nationkey#"), F.col("s_nationkey").cast("string"))) for b in bodies]
    html = F.element_at(F.array(*made), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return markup.structured(t.supplier.select("s_suppkey", html.alias("html")), "s_suppkey", "html", "JobPosting", {"title": "$.title", "org": "$.hiringOrganization.name"})


@query("s17_paragraphs", r"""
WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS ws FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g')) <> ''),
i AS (SELECT doc_id, ws, unnest(range(0, len(ws), 300)) AS k FROM w) SELECT doc_id, (k // 300)::INTEGER AS pos, array_to_string(ws[k + 1 : k + 300], ' ') AS paragraph FROM i""")  # fmt: skip
def s17(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.posexplode(D.paragraphs(F.col("text"))).alias("pos", "paragraph"))


@query("t03_short_age", f"""
WITH a AS (SELECT event_id, epoch_ms(TIMESTAMP '{NOW}') // 1000 - epoch_ms(ts) // 1000 - 86400 * (event_id % 700 - 3) AS a FROM events), s AS (SELECT event_id, a, greatest(a, 0) AS s FROM a)
SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN s // 60 || 'm ago' WHEN s < 86400 THEN s // 3600 || 'h ago' WHEN s < 2592000 THEN s // 86400 || 'd ago' WHEN s < 31104000 THEN s // 2592000 || 'mo ago' ELSE s // 31536000 || 'y ago' END AS age,
CASE WHEN a < 0 OR a > 604800 THEN 'old' WHEN a > 172800 THEN 'recent' ELSE 'fresh' END AS class FROM s""")  # fmt: skip
def t03(t: Tables) -> DataFrame:
    age = F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp")) - 86_400 * (F.col("event_id") % 700 - 3)
    return t.events.select("event_id", D.short_age(age).alias("age"), D.age_class(age).alias("class"))


@query("t12_lakhs", "SELECT o_orderkey, '₹' || CASE WHEN o_totalprice >= 100000 THEN n // 10 || CASE WHEN n % 10 > 0 THEN '.' || n % 10 ELSE '' END || 'L' ELSE floor(o_totalprice)::BIGINT::VARCHAR END AS shown FROM (SELECT *, floor(o_totalprice / 10000 + 0.5)::BIGINT AS n FROM orders)")
def t12(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", D.lakhs(F.col("o_totalprice")).alias("shown"))


@query("x22_command", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'details' WHEN 1 THEN 'jobs' WHEN 2 THEN 'salary' ELSE 'help' END AS name, CASE WHEN c_custkey % 4 = 0 THEN '9' || lpad(c_custkey::VARCHAR, 9, '0') END AS number,
CASE c_custkey % 4 WHEN 0 THEN 'Site ' || c_name WHEN 1 THEN c_name WHEN 2 THEN '' ELSE 'jobless ' || c_name END AS rest FROM customer""")  # fmt: skip
def x22(t: Tables) -> DataFrame:
    text = _said("c_custkey", 4, "+91 9{lpad(c_custkey, 9, '0')}  Site {c_name}", " JOBS  {c_name} ", "salary", "jobless {c_name}")
    return t.customer.select("c_custkey", D.command(text, ["jobs?", "exam", "salary", "subscribe", "start", "help"]).alias("c")).select("c_custkey", "c.*")


@query("x24_label_of", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Building' WHEN 'HOUSEHOLD' THEN 'HouseHold' END AS label FROM customer")
def x24(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", D.label_of(F.concat(F.lit(" "), "c_mktsegment"), ["Building", "HouseHold"]).alias("label"))


@query("x25_landing", "SELECT p_partkey, CASE WHEN p_partkey % 4 < 2 THEN split_part(p_name, ' ', 2) END AS role, CASE WHEN p_partkey % 4 = 0 THEN 'navi-mumbai' END AS place FROM part WHERE p_name LIKE '% widget' OR p_name LIKE '% ring'")
def x25(t: Tables) -> DataFrame:
    rows = t.part.where(F.col("p_name").rlike(" (widget|ring)$")).withColumn("r", F.split_part("p_name", F.lit(" "), F.lit(2)))
    path = _said("p_partkey", 4, "/{upper(r)}-jobs-in-navi-mumbai/", "/{r}-jobs", "/{r}-jobs-in-rome", "/{r}")
    return rows.select("p_partkey", D.landing(path, ["widget", "ring"], ["pune", "navi-mumbai"]).alias("l")).select("p_partkey", "l.*")


@query("y05_json", """SELECT p_partkey, '{"name":"' || p_name || '","size":' || p_size || ',"tags":["' || p_brand || '","' || p_type || '"]}' AS json FROM part""")
def y05(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.array("p_brand", "p_type").alias("tags"))).alias("json"))


@query("y06_resolved", """
SELECT l_orderkey, CASE l_orderkey % 3 WHEN 0 THEN min(l_linenumber) FILTER (WHERE l_returnflag = 'R')::VARCHAR WHEN 1 THEN arg_max(l_linenumber, l_quantity * 1000 - l_linenumber)::VARCHAR ELSE 'said' END AS value FROM lineitem GROUP BY l_orderkey""")  # fmt: skip
def y06(t: Tables) -> DataFrame:
    one = F.struct("l_linenumber", F.col("l_linenumber").cast("string").alias("value"), (F.col("l_returnflag") == "R").alias("official"), F.col("l_quantity").cast("double").alias("confidence"))
    rows = t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(one)).alias("v"))
    how = F.element_at(F.array(*map(F.lit, ("official", "highest", "manual"))), (F.col("l_orderkey") % 3 + 1).cast("int"))
    return rows.select("l_orderkey", D.resolved(F.col("v"), how, F.lit("said")).alias("value"))


@query("g09_course_stats", """
SELECT count(*) AS total, count(*) FILTER (WHERE p_size > 25) AS published, count(*) FILTER (WHERE p_brand = 'Brand#1') AS own, (SELECT count(*) FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)) AS clicks FROM part""")  # fmt: skip
def g09(t: Tables) -> DataFrame:
    clicks = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = t.part.join(clicks, "p_partkey", "left")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("p_size") > 25).alias("published"), F.count_if(F.col("p_brand") == "Brand#1").alias("own"), F.coalesce(F.sum(F.when(F.col("p_size") > 25, F.col("n"))), F.lit(0)).alias("clicks"))


@query("g24_radar", """
SELECT count(*) FILTER (WHERE CAST(o_orderdate AS DATE) = DATE '1997-03-01') AS today, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-03-08') AS closing, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent FROM orders""")  # fmt: skip
def g24(t: Tables) -> DataFrame:
    day, on = F.to_date("o_orderdate"), F.lit("1997-03-01").cast("date")
    return t.orders.agg(F.count_if(day == on).alias("today"), F.count_if(F.datediff(day, on).between(0, 6)).alias("closing"), F.count_if(F.col("o_orderpriority").startswith("1")).alias("urgent"))


@query("g25_audit_split", "SELECT CASE WHEN length(text) < 40 THEN 'garbage' WHEN length(text) < 400 THEN 'weak' ELSE 'good' END AS verdict, count(*) AS n, min(doc_id) AS example FROM documents WHERE text IS NOT NULL GROUP BY 1")
def g25(t: Tables) -> DataFrame:
    n = F.char_length("text")
    verdict = F.when(n < 40, "garbage").when(n < 400, "weak").otherwise("good")
    return t.documents.where("text IS NOT NULL").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("example"))


@query("j02_embedded", """
SELECT o_orderkey, coalesce(n, 0) AS n, coalesce(lines, '') AS lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")  # fmt: skip
def j02(t: Tables) -> DataFrame:
    lines = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list("l_linenumber")).alias("v"))
    v = F.coalesce("v", F.array().cast("array<int>"))
    return t.orders.join(lines, "o_orderkey", "left").select("o_orderkey", F.size(v).cast("bigint").alias("n"), F.array_join(v.cast("array<string>"), ",").alias("lines"))


@query("l06_caps", "SELECT o_orderkey FROM (SELECT * FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 80) ORDER BY o_totalprice DESC, o_orderkey LIMIT 40) WHERE o_orderstatus <> 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def l06(t: Tables) -> DataFrame:
    rows = t.orders.orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(80)
    rows = rows.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(40)
    return rows.where("o_orderstatus <> 'F'").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(12).select("o_orderkey")


@query("r09_landing_score", """
SELECT p_partkey, 95 + CASE WHEN p_size > 40 THEN 3 ELSE 0 END AS score FROM part WHERE p_name LIKE '%widget%' AND p_type = 'ECONOMY' ORDER BY score DESC, p_partkey LIMIT 12""")  # fmt: skip
def r09(t: Tables) -> DataFrame:
    role, place = F.col("p_name").contains("widget"), F.col("p_type") == "ECONOMY"
    score = S.points([(role, 50), (place, 45), (F.col("p_size") > 40, 3)])
    return t.part.where(role & place).select("p_partkey", score.alias("score")).orderBy(F.desc("score"), "p_partkey").limit(12)


@query("r04_recommended", """
WITH s AS (SELECT p_partkey, CASE WHEN p_name LIKE '%widget%' THEN 5 ELSE 0 END + CASE WHEN p_type = 'ECONOMY' THEN 4 ELSE 0 END
+ least(6, 2 * len([w FOR w IN ['red', 'cold', 'small', 'brand#1', 'brand#2'] IF contains(lower(p_name || ' ' || p_brand), w)])) + CASE WHEN p_size <= 7 THEN 2 WHEN p_size <= 30 THEN 1 ELSE 0 END AS score FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49))
SELECT p_partkey, score::INTEGER AS score FROM s WHERE score > 0 ORDER BY score DESC, p_partkey LIMIT 12""")  # fmt: skip
def r04(t: Tables) -> DataFrame:
    hay = F.lower(F.concat_ws(" ", "p_name", "p_brand"))
    hits = scores.mentioned(hay, ["red", "cold", "small", "brand#1", "brand#2"])
    score = S.points([(F.col("p_name").contains("widget"), 5), (F.col("p_type") == "ECONOMY", 4)]) + F.least(F.lit(6), 2 * hits) + F.when(F.col("p_size") <= 7, 2).when(F.col("p_size") <= 30, 1).otherwise(0)
    known = t.lineitem.where("l_quantity > 49").select(F.col("l_partkey").alias("p_partkey"))
    rows = t.part.join(known, "p_partkey", "left_anti").select("p_partkey", score.cast("int").alias("score"))
    return rows.where("score > 0").orderBy(F.desc("score"), "p_partkey").limit(12)

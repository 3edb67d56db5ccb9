"""Queries of titles, posts in messages, links, graded posts and matches with people; texts are made from the tables' columns, the SQL gives what went in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import fields as D
from tessera.functions import titles as T
from tessera.functions.text import first_label
from tessera.operators import alerts, scores, sinks
from tessera.operators import verdicts as V
from tessera.operators.tables import by_distinct
from tessera.plans.fields import _said
from tessera.plans.registry import Tables, query
from tessera.sources import links as L
from tessera.sources import markup


@query("x13_role_company", """
SELECT c_custkey, CASE c_custkey % 5 WHEN 4 THEN 'Planner' ELSE 'Site Engineer' END AS role,
CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN 'Works at ' || c_name WHEN 2 THEN c_name WHEN 3 THEN c_name || ', Pune' END AS company FROM customer""")  # fmt: skip
def x13(t: Tables) -> DataFrame:
    title = _said("c_custkey", 5, "Site Engineer at {c_name}", "<b>Site Engineer</b> - Works at {c_name}", "Site Engineer", "Site Engineer | {c_name}, Pune", "Planner")
    body = _said("c_custkey", 5, "Employer: none", "", "We hire. Company: {c_name} | Pune", "Employer: none", "nothing said")
    return t.customer.select("c_custkey", T.role_and_company(title, body).alias("r")).select("c_custkey", "r.*")


@query("x14_title_verdict", """
SELECT p_partkey, ['ok', 'ok', 'junk', 'other page', 'junk', 'weak', 'weak', 'ok', 'junk', 'junk'][p_partkey % 10 + 1] AS verdict,
[NULL, NULL, 'text of a link', 'no vacancy', 'too short', 'headline', 'names no post', NULL, 'no title', 'text of a link'][p_partkey % 10 + 1] AS reason,
['Junior Engineer ' || p_size, 'Site Engineer (Civil)', '', 'Final result of engineers ' || p_size, 'JE ' || p_size, 'The board invites applications, engineers', 'Board of roads ' || p_size,
'Recruitment of Apprentice (Civil) B.E.', '', ''][p_partkey % 10 + 1] AS title FROM part""")  # fmt: skip
def x14(t: Tables) -> DataFrame:
    said = (
        "Advertisement for the post of Junior  Engineer {p_size}",
        "Notification: notice - Site Engineer (Civil) on Direct Recruitment basis.",
        "Click here for {p_size}",
        "Final result of engineers {p_size}",
        "JE {p_size}",
        "The board invites applications, engineers",
        "Board of roads {p_size} -",
        "Recruitment of Apprentice (Civil) B.E.",
        " ",
        "VACANCY",
    )
    return by_distinct(t.part, _said("p_partkey", 10, *said), T.title_verdict, "v").select("p_partkey", "v.*")


@query("x14_cut_title", "SELECT p_partkey, 'Engineer for bridges, roads and water' || repeat(' works', (140 - 37) // 6) AS title FROM part")
def x14b(t: Tables) -> DataFrame:
    title = F.concat(F.lit("For the posts of Engineer for bridges, roads and water"), F.repeat(F.lit(" works"), F.col("p_size") + 30))
    return by_distinct(t.part, title, T.cleaned_title, "title").select("p_partkey", "title")


@query("x15_link_title", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'junior engineer ' || p_size WHEN 1 THEN 'Site Engineer' WHEN 2 THEN 'View details' WHEN 3 THEN 'civil works ' || p_size || ' posts' ELSE 'apply' END AS title FROM part""")  # fmt: skip
def x15(t: Tables) -> DataFrame:
    text = _said("p_partkey", 5, "Apply Now", "Site Engineer", "View  details", "Download", "apply")
    url = _said("p_partkey", 5, "https://a.org/x/junior-engineer_{p_size}/{p_partkey}/?a=b", "https://a.org/junior-engineer-posts", "https://a.org/jobs/", "https://a.org/civil-works-{p_size}-posts.html", "no address")
    return t.part.select("p_partkey", T.link_title(text, url).alias("title"))


@query("e01_posts", """
WITH p AS (SELECT p_partkey, p_size, CASE p_partkey % 4 WHEN 0 THEN [{'title': 'Site Engineer', 'block': '1. Site Engineer - 4-6 LPA
Salary: ' || p_size || '
Skills: AutoCAD, planning'}, {'title': 'Quantity Surveyor', 'block': 'Quantity Surveyor:
two needed for the site, we are waiting
Acme Infrastructure Pvt Ltd'}]
WHEN 1 THEN [{'title': 'Come to number ' || p_size, 'block': 'Come to number ' || p_size || '
Location
Planning is what we do.'}] WHEN 2 THEN [{'title': 'Billing Engineer', 'block': 'Billing Engineer (20k)'}] ELSE [] END AS j FROM part)
SELECT p_partkey, CAST(i AS INTEGER) AS place, j[i + 1].title AS title, j[i + 1].block AS block FROM (SELECT p_partkey, j, unnest(range(len(j))) AS i FROM p)""")  # fmt: skip
def e01(t: Tables) -> DataFrame:
    text = _said(
        "p_partkey",
        4,
        "We are hiring\n\n1. Site Engineer - 4-6 LPA\nSalary: {p_size}\nSkills: AutoCAD, planning\n\nQuantity Surveyor:\ntwo needed for the site, we are waiting\nAcme Infrastructure Pvt Ltd",
        "Come to number {p_size}\nLocation\nPlanning is what we do.",
        "- \nBilling Engineer (20k)\n",
        " \n",
    )
    rows = by_distinct(t.part, text, T.posts, "posts").select("p_partkey", F.posexplode("posts").alias("place", "j"))
    return rows.select("p_partkey", "place", "j.title", "j.block")


@query("e13_posting", """
SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'City ' || s_nationkey WHEN 1 THEN 'Pune' END AS city, CASE s_suppkey % 5 WHEN 0 THEN 'R' END AS region, CASE s_suppkey % 5 WHEN 0 THEN 'India' WHEN 1 THEN 'IN' END AS country,
CASE s_suppkey % 5 WHEN 0 THEN 'City ' || s_nationkey || ', R, India' WHEN 1 THEN 'Pune, IN' WHEN 2 THEN 'near ' || s_nationkey END AS location,
CASE s_suppkey % 5 WHEN 0 THEN 'INR ' || s_nationkey || ' - 900 MONTH' WHEN 1 THEN 'INR ' || s_nationkey WHEN 3 THEN '- ' || s_nationkey || ' YEAR' END AS pay FROM supplier""")  # fmt: skip
def e13(t: Tables) -> DataFrame:
    places = (
        '[{"address": {"addressLocality": "City #", "addressRegion": "R", "addressCountry": {"name": "India"}}}, "x"]',
        '{"addressCity": "Pune", "addressCountry": "IN"}',
        '"near #"',
        '{"address": {"addressRegion": " ", "addressCountry": {}}}',
        "null",
    )
    pays = (
        '{"currency": "INR", "value": {"minValue": #, "maxValue": 900, "unitText": "MONTH"}}',
        '{"value": {"currency": "INR", "minValue": #, "maxValue": #}}',
        '{"currency": "INR", "value": #}',
        '{"maxValue": #, "unitText": "YEAR"}',
        "null",
    )
    page = '<script type="application/ld+json">{{"@type": "JobPosting", "jobLocation": {}, "baseSalary": {}}}</script>'
    made = F.array(*[F.lit(page.format(*x)) for x in zip(places, pays, strict=True)])
    html = F.replace(F.get(made, (F.col("s_suppkey") % 5).cast("int")), F.lit("#"), F.col("s_nationkey").cast("string"))
    fields = {"place": "$.jobLocation", "pay": "$.baseSalary"}
    rows = markup.structured(t.supplier.select("s_suppkey", html.alias("html")), "s_suppkey", "html", "JobPosting", fields)
    return rows.select("s_suppkey", D.posted_place(F.col("place")).alias("p"), D.posted_pay(F.col("pay")).alias("pay")).select("s_suppkey", "p.*", "pay")


@query("e15_search", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Site Engineer' WHEN 1 THEN 'Planner' END AS role, CASE c_custkey % 4 WHEN 0 THEN 'Pune' END AS city, CASE c_custkey % 4 WHEN 2 THEN 'Kerala' END AS state,
CAST(CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 0 END AS DOUBLE) AS years, CAST(CASE c_custkey % 4 WHEN 0 THEN 4.5 WHEN 2 THEN 6 END AS DOUBLE) AS lakhs, CASE c_custkey % 4 WHEN 1 THEN 'Government' WHEN 2 THEN 'Private' END AS sector,
CAST(CASE c_custkey % 4 WHEN 1 THEN 7 WHEN 2 THEN 1 END AS INTEGER) AS days,
CASE c_custkey % 4 WHEN 0 THEN ['engineers', 'with', 'years', 'lpa'] WHEN 1 THEN ['govt', 'fresher', 'this', 'week'] WHEN 2 THEN ['private', 'jobs', 'above', 'today'] ELSE [] END AS keywords, c_custkey % 4 < 3 AS confident FROM customer""")  # fmt: skip
def e15(t: Tables) -> DataFrame:
    text = _said("c_custkey", 4, "Site  engineers in Pune with 3+ years 4.5 LPA", "Planner govt fresher this week roads", "private jobs Kerala above ₹6 today", "customer {c_custkey}")
    roles = {"Site Engineer": ["site engineer", "se civil"], "Planner": ["planner", "planning"]}
    found = T.search(text, roles, ["Pune", "Chennai"], ["Maharashtra", "Kerala"])
    return t.customer.select("c_custkey", found.alias("s")).select("c_custkey", "s.role", "s.city", "s.state", "s.years", "s.lakhs", "s.sector", "s.days", "s.keywords", "s.confident")


def _anchored(t: Tables) -> DataFrame:
    """Links of a made page of each supplier: key, pos, url, text."""
    page = ('<a href="/careers/?utm_source=x">Join us</a><a href="jobs/{s_suppkey}">Current openings</a><a href="/careers">Careers</a><a href="https://board.com/careers">Careers</a>'
            '<a href="mailto:a@b.c">Jobs</a><a href="/job/{s_suppkey}">Site Engineer, civil</a><a href="/job/{s_suppkey}#top">Civil again</a><a href="/job/0-sales">Civil sales head</a><a href="/job/1">View all</a>'
            '<a href="https://x.gov.in/a.PDF">Read</a><a href="https://x.gov.in/list">Details</a><a href="https://x.gov.in/advt.pdf?v=1">Notification</a><a href="https://x.gov.in/list">list</a><a href="//x.gov.in/z">z</a>')  # fmt: skip
    pages = t.supplier.select("s_suppkey", _said("s_suppkey", 1, page).alias("html"))
    base = F.concat(F.lit("https://firm"), F.col("s_suppkey").cast("string"), F.lit(".com/about/us?x=/"))
    return markup.anchors(pages, "s_suppkey", "html").select("s_suppkey", "pos", L.absolute(F.col("href"), base).alias("url"), "text").where("url IS NOT NULL")


def _board() -> Column:
    return F.col("url").rlike("^https?://board[.]com/")


@query("s10_careers", """
SELECT s_suppkey, 0 AS pos, 'https://firm' || s_suppkey || '.com/careers/?utm_source=x' AS url, FALSE AS "primary" FROM supplier
UNION ALL SELECT s_suppkey, 1, 'https://firm' || s_suppkey || '.com/about/jobs/' || s_suppkey, TRUE FROM supplier""")  # fmt: skip
def s10(t: Tables) -> DataFrame:
    found = L.careers(_anchored(t), "s_suppkey", "url", "text", "pos", r"\b(?:careers?|jobs|openings)\b", r"openings|careers", _board())
    return found.select("s_suppkey", "pos", "url", "primary")


@query("s11_post_links", """SELECT s_suppkey, 5 AS pos, 'https://firm' || s_suppkey || '.com/job/' || s_suppkey AS url, 'Site Engineer, civil' AS text FROM supplier""")
def s11(t: Tables) -> DataFrame:
    return L.posts(_anchored(t), "s_suppkey", "url", "text", "pos", "/job/", r"\bcivil\b", r"\bsales\b", "view all|home", _board())


@query("s12_official", """
SELECT s_suppkey, v.* FROM supplier, (VALUES (11, 'https://x.gov.in/advt.pdf?v=1', 5, 1), (9, 'https://x.gov.in/a.PDF', 3, 2), (10, 'https://x.gov.in/list', 2, 3), (13, 'https://x.gov.in/z', 0, 4)) v(pos, url, score, place)""")  # fmt: skip
def s12(t: Tables) -> DataFrame:
    return L.official(_anchored(t), "s_suppkey", "url", "text", "pos", F.col("url").contains(".gov.in/")).select("s_suppkey", "pos", "url", "score", "place")


@query("s13_adapter", "SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]*[.]org(/|$)') THEN 'org' WHEN regexp_matches(url, '^https?://m[.]') THEN 'mobile' ELSE 'generic' END AS adapter FROM pages WHERE url IS NOT NULL")
def s13(t: Tables) -> DataFrame:
    return t.pages.where("url IS NOT NULL").select("page_id", L.adapter(F.col("url"), {"org": "[.]org$", "mobile": "^m[.]"}).alias("adapter"))


@query("s05_keyed_feeds", "SELECT c_custkey AS id, c_name AS title, 'customers' AS _source FROM customer UNION ALL SELECT s_suppkey, s_name, 'suppliers' FROM supplier")
def s05(t: Tables) -> DataFrame:
    feeds = {
        "customers": ("key", lambda _: t.customer.selectExpr("c_custkey AS id", "c_name AS title")),
        "parts": (None, lambda _: t.absent),
        "suppliers": ("key", lambda _: t.supplier.selectExpr("s_suppkey AS id", "s_name AS title")),
    }
    return L.keyed(feeds, ["id", "title"])


@query("s16_pages", "SELECT o_orderkey, o_totalprice, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1 AS INTEGER) AS page FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 50000)")
def s16(t: Tables) -> DataFrame:
    return sinks.numbered_pages(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey")


@query("s19_seeds", """
SELECT s_suppkey, CASE WHEN c_custkey IS NOT NULL THEN c_name ELSE s_name END AS s_name, s_acctbal FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey AND c_custkey % 2 = 0
UNION ALL SELECT c_custkey, c_name, NULL FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT s_suppkey FROM supplier)""")  # fmt: skip
def s19(t: Tables) -> DataFrame:
    seeds = t.customer.where("c_custkey % 2 = 0").selectExpr("c_custkey AS s_suppkey", "c_name AS s_name")
    return sinks.seeded(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), seeds, "s_suppkey")


@query("k01_insertable", """
SELECT s_suppkey, s_name, s_acctbal FROM supplier UNION ALL SELECT c_custkey, c_name, NULL FROM customer UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer""")  # fmt: skip
def k01(t: Tables) -> DataFrame:
    stored = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    rows = t.customer.selectExpr("c_custkey AS s_suppkey", "c_name AS s_name", "c_acctbal AS s_acctbal", "c_mktsegment AS unknown")
    one = sinks.insertable(stored, rows, ["s_suppkey", "s_name"])
    return stored.unionByName(one).unionByName(sinks.insertable(stored, rows.drop("unknown"), ["s_suppkey"]))


@query("o12_next_batch", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' ORDER BY o_orderkey LIMIT 500")
def o12(t: Tables) -> DataFrame:
    items = t.orders.select("o_orderkey", "o_orderstatus")
    return sinks.next_batch(items, items.where("o_orderstatus = 'F'"), "o_orderkey", 500)


@query("c01_role_accepted", """
SELECT p_partkey, p_partkey % 6 IN (0, 1, 3) AS accepted, ['role', 'practices', 'other role', 'context with practices', 'context alone', 'no such role'][p_partkey % 6 + 1] AS reason FROM part""")  # fmt: skip
def c01(t: Tables) -> DataFrame:
    title = _said("p_partkey", 6, "Sales head {p_size}", "Sales head", "Sales head", "Helper {p_size}", "Helper", "Helper")
    body = _said("p_partkey", 6, "once a site engineer", "site supervision of {p_name}", "roads {p_size}", "roads, concrete works", "roads", "{p_name}")
    said = V.role_accepted(title, body, ["site engineer"], ["sales"], ["roads"], ["site supervision", "concrete works"])
    return t.part.select("p_partkey", said.alias("r")).select("p_partkey", "r.*")


def _level(text: Column, stated: Column) -> Column:
    possible = V.has_word(text, ["any discipline"]) | (V.has_word(text, ["junior engineer"]) & V.has_word(text, ["pwd"]))
    return V.level(text, stated, ["civil judge", "software"], ["civil engineer", "site engineer"], ["quantity surveyor"], possible)


@query("c07_level", "SELECT p_partkey, ['none', 'related', 'direct', 'related', 'possible', 'possible', 'none', 'none'][p_partkey % 8 + 1] AS level FROM part")
def c07(t: Tables) -> DataFrame:
    text = _said("p_partkey", 8, "Civil Judge, site engineer", "clerk {p_size}", "Site Engineer, quantity surveyor", "quantity surveyor {p_size}", "any discipline", "junior engineer at PWD", "junior engineer {p_size}", "")
    return t.part.select("p_partkey", _level(text, (F.col("p_partkey") % 8).isin(0, 1, 7)).alias("level"))


#: Specialisations in order of precedence.
SPECIAL = [
    ("project-construction-management", r"(?i)\b(?:project|construction)\s+(?:management|manager)\b"), ("quantity-surveying", r"(?i)\bquantity survey\w*\b"), ("urban-planning", r"(?i)\b(?:urban|town)\s+plann\w+\b"),
    ("urban-infrastructure", r"(?i)\burban\s+infra\w*\b"), ("water-resources", r"(?i)\bwater\s+resources\b"), ("irrigation", r"(?i)\birrigation\b"), ("hydraulics", r"(?i)\bhydraul\w+\b"), ("remote-sensing", r"(?i)\bremote sensing\b"),
    ("gis", r"(?i)\b(?:gis|geographic information system)\b"), ("bim", r"(?i)\bbim\b"), ("estimation", r"(?i)\bestimat\w+\b"), ("coastal", r"(?i)\bcoastal\b"), ("bridge", r"(?i)\bbridge\b"), ("railway", r"(?i)\brail\s*way\b"),
    ("highway", r"(?i)\bhighway\b"), ("transportation", r"(?i)\btransportation|transport\s+engineer"), ("geotechnical", r"(?i)\bgeotech\w+\b"), ("environmental", r"(?i)\benvironmental\b"), ("surveying", r"(?i)\bsurvey(?:ing|or)\b"),
    ("structural", r"(?i)\bstructural\b"), ("construction", r"(?i)\bconstruction\b"), ("building", r"(?i)\bbuilding\b"), ("planning", r"(?i)\bplanning\b"), ("infrastructure", r"(?i)\binfrastructure\b"), ("general-civil", r"(?i)\bcivil\b"),
]


@query("c08_specialisation", """
SELECT p_partkey, ['quantity-surveying', 'structural', 'urban-planning', 'general-civil', NULL, 'railway', 'surveying', 'project-construction-management'][p_partkey % 8 + 1] AS special FROM part""")  # fmt: skip
def c08(t: Tables) -> DataFrame:
    text = _said("p_partkey", 8, "Quantity Surveyor, bridge", "structural building {p_size}", "Town planning of a highway", "civil work {p_size}", "{p_name}", "rail way construction", "Land surveyor, civil", "Construction Manager, bridge")
    return t.part.select("p_partkey", first_label(SPECIAL, text).alias("special"))


@query("c09_by_hits", """
SELECT p_partkey, ['unwanted', 'wanted', 'wanted', 'unknown', 'unknown'][p_partkey % 5 + 1] AS status, ['C', 'A', 'A', 'B', 'U'][p_partkey % 5 + 1] AS tier,
CAST([0, 86, 100, 55, 20][p_partkey % 5 + 1] AS INTEGER) AS score, CAST([0.98, 0.9, 0.9, 0.65, 0.3][p_partkey % 5 + 1] AS DOUBLE) AS confidence FROM part""")  # fmt: skip
def c09(t: Tables) -> DataFrame:
    text = _said("p_partkey", 5, "civil court, roads, bridges", "roads and bridges {p_size}", "roads bridges surveyor highway", "roads {p_size}", "{p_name}")
    return t.part.select("p_partkey", V.by_hits(text, ["civil court"], ["roads", "bridges", "surveyor", "highway"]).alias("v")).select("p_partkey", "v.*")


@query("c10_selected", """
SELECT p_partkey, p_partkey % 6 NOT IN (0, 3) AS kept, ['branches exclude it', 'qualification', 'role', 'none', 'section', 'qualification'][p_partkey % 6 + 1] AS evidence, p_partkey % 6 IN (2, 4) AS eligible FROM part""")  # fmt: skip
def c10(t: Tables) -> DataFrame:
    post = _said("p_partkey", 6, "Site engineer", "Clerk", "Site Engineer", "Site engineer", "Clerk {p_size}", "Clerk")
    asked = _said("p_partkey", 6, "mechanical", "civil or mechanical", "any {p_size}", "any", "any", "Civil {p_size}")
    explicit, by_role = (F.col("p_partkey") % 6).isin(2, 3), F.col("p_partkey") % 6 == 2
    both = F.concat_ws(" ", post, asked)
    return t.part.select("p_partkey", V.selected(both, both, post, explicit, by_role, "civil", ["mechanical", "electrical"], ["site engineer"]).alias("s")).select("p_partkey", "s.*")


@query("c12_course", """
SELECT p_partkey, ['Bridges', NULL, NULL, NULL, 'CAD', 'quantity-surveying', 'general', 'general', NULL, NULL][p_partkey % 10 + 1] AS topic,
['editor', 'no text', 'veto', 'other branch', 'topic', 'related', 'direct', 'general word', 'needs an editor', 'no topic'][p_partkey % 10 + 1] AS reason FROM part""")  # fmt: skip
def c12(t: Tables) -> DataFrame:
    text = _said("p_partkey", 10, "software", "", "software, autocad for buildings", "electrical works", "AutoCAD for buildings, electrical and concrete", "quantity surveyor {p_size}", "site engineer {p_size}", "civil {p_size}", "any discipline", "autocad {p_size}")
    given = F.when(F.col("p_partkey") % 10 == 0, "Bridges")
    special = first_label([s for s in SPECIAL if s[0] != "general-civil"], text)
    cad = V.has_word(text, ["autocad"]) & V.has_word(text, ["buildings"])
    found = V.course(given, text, V.has_word(text, ["software"]), ["electrical"], ["concrete"], [("CAD", cad)], _level(text, F.lit(False)), special, ["civil"])
    return t.part.select("p_partkey", found.alias("c")).select("p_partkey", "c.*")


@query("c16_scope", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'unknown provider' WHEN p_type <> 'PROMO' THEN 'other topic' END AS reason FROM part")
def c16(t: Tables) -> DataFrame:
    provider = F.when(F.col("p_size") < 10, F.lit(None)).otherwise("site")
    return t.part.select("p_partkey", V.first_failure([("unknown provider", provider.isNull()), ("other topic", F.col("p_type") != "PROMO")]).alias("reason"))


@query("r06_facets", """
WITH f AS (SELECT p_partkey, [contains(p_name, 'widget'), p_size > 20, CASE WHEN p_size > 5 THEN p_type = 'PROMO' END] AS f FROM part),
n AS (SELECT p_partkey, len(list_filter(f, lambda x: x)) AS h, len(list_filter(f, lambda x: NOT x)) AS m FROM f)
SELECT p_partkey, CAST(greatest(35, least(96, floor(40 + (18 * h + 6 * m) / greatest(h + m, 1) * 2 + 0.5))) AS INTEGER) AS score FROM n""")  # fmt: skip
def r06(t: Tables) -> DataFrame:
    facets = [F.col("p_name").contains("widget"), F.col("p_size") > 20, F.when(F.col("p_size") > 5, F.col("p_type") == "PROMO")]
    return t.part.select("p_partkey", scores.facet_score(facets).alias("score"))


@query("r07_preferences", """
SELECT p_partkey, CAST(CASE WHEN p_name LIKE 'red %' OR p_name LIKE 'small %' THEN 25 WHEN p_name LIKE '%widget%' THEN 12 ELSE 0 END
+ floor(25 * (contains(p_name, 'cold')::INT + contains(p_name, 'widget')::INT) / 2 + 0.5) + CASE WHEN p_type = 'PROMO' THEN 20 WHEN p_type = 'ECONOMY' THEN 15 ELSE 0 END
+ CASE WHEN p_size BETWEEN 3 AND 30 THEN 15 ELSE 0 END + CASE WHEN p_retailprice >= 920 * 0.85 THEN 10 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 5 ELSE 0 END AS INTEGER) AS score FROM part""")  # fmt: skip
def r07(t: Tables) -> DataFrame:
    words = lambda *w: F.array(*map(F.lit, w))
    wants = {"roles": words("red widget", "small things"), "skills": words("cold", "widget"), "places": words("promo"), "least_years": F.lit(5), "most_years": F.lit(30), "least_pay": F.lit(920), "sector": F.lit("Government")}
    place = F.when(F.col("p_type") == "ECONOMY", "remote").otherwise(F.lower("p_type"))
    sector = F.when(F.col("p_size") % 2 == 0, "Public Sector").otherwise("Private")
    has = {"title": F.col("p_name"), "text": F.col("p_name"), "place": place, "years": F.col("p_size"), "pay": F.col("p_retailprice"), "sector": sector}
    return t.part.select("p_partkey", scores.preference_score(wants, has).alias("score"))


@query("r08_profile", """
SELECT p_partkey, CAST(greatest(5, least(98, 40 + CASE WHEN p_name LIKE '%widget%' THEN 25 ELSE -12 END + CASE WHEN p_type = 'PROMO' THEN 20 ELSE -6 END
+ least(12, 5 * (contains(p_name, 'red')::INT + contains(p_name, 'widget')::INT + contains(p_name, 'w')::INT)) + CASE WHEN p_size < 5 THEN 10 ELSE 0 END + CASE WHEN p_size > 30 THEN 5 ELSE 0 END
+ CASE WHEN p_retailprice < 915 THEN 4 ELSE -25 END)) AS INTEGER) AS score FROM part""")  # fmt: skip
def r08(t: Tables) -> DataFrame:
    size = F.col("p_size")
    skills = F.array(F.lit("red"), F.lit("widget"), F.lit("w"))
    score = scores.profile_score(F.lit("widget"), F.lit("promo"), skills, F.lit(True), F.col("p_name"), F.lower("p_type"), size < 5, size > 30, F.col("p_retailprice") < 915)
    return t.part.select("p_partkey", score.alias("score"))


@query("r10_alerts", """
WITH a AS (SELECT s_suppkey, ['all', 'private', 'government'][s_suppkey % 3 + 1] AS kind, CASE WHEN s_suppkey % 2 = 0 THEN ['red', 'cold'] ELSE [] END AS words, CASE WHEN s_suppkey % 5 = 0 THEN ['widget'] ELSE [] END AS fields FROM supplier)
SELECT s_suppkey, p_partkey FROM a JOIN part ON (kind = 'all' OR (kind = 'government') = (p_type = 'PROMO')) AND (len(words) = 0 OR p_name LIKE '%red%' OR p_name LIKE '%cold%') AND (len(fields) = 0 OR p_name LIKE '%widget%')""")  # fmt: skip
def r10(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    listed = lambda test, *w: F.when(test, F.array(*map(F.lit, w))).otherwise(F.array().cast("array<string>"))
    kind = F.get(F.array(F.lit("all"), F.lit("private"), F.lit("government")), (k % 3).cast("int"))
    made = t.supplier.select("s_suppkey", kind.alias("kind"), listed(k % 2 == 0, "red", "cold").alias("keywords"), listed(k % 5 == 0, "widget").alias("fields"))
    sector = F.when(F.col("p_type") == "PROMO", "Public Sector").otherwise("Private")
    parts = t.part.select("p_partkey", "p_name", sector.alias("sector"))
    return alerts.matches_of_kinds(made, parts, "s_suppkey", "p_partkey", "p_name", alerts.sector_gate(F.col("kind"), F.col("sector")))

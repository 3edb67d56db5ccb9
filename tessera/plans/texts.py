"""Text functions, extraction and markup over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.amounts import years
from tessera.plans.registry import Tables, query
from tessera.sources import markup


@query("x01_clean_text", r"""
SELECT page_id, trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(replace(replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '&(#39|apos);', '''', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""")  # fmt: skip
def x01(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.clean_text(F.col("html")).alias("text"))


@query("x02_norm_text", r"SELECT doc_id, trim(regexp_replace(lower(trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(text, '&amp;', '&'), '&quot;', '\"'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), '[^a-z0-9]+', ' ', 'g')) AS norm FROM documents".replace('\\"', '"'))
def x02(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.norm_text(F.col("text")).alias("norm"))


@query("x03_strip_html", r"""
WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', ' ', 'g'), '(?i)</(?:p|div|li|tr|h[1-6])\s*>|<br\s*/?\s*>', chr(10), 'g'), '<[^>]*>', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(x, '&#39;', ''''), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS x FROM a)
SELECT page_id, trim(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), ' *\n\s*', chr(10), 'g'), ' ' || chr(10)) AS text FROM b""")  # fmt: skip
def x03(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.strip_html(F.col("html")).alias("text"))


@query("x04_clean_lines", r"""
SELECT doc_id, left(trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10)), 12000) AS text FROM documents""")  # fmt: skip
def x04(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.clean_lines(F.col("text")).alias("text"))


@query("x05_slug", "SELECT p_partkey, trim(left(trim(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), 18), '-') AS slug FROM part")
def x05(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.slug(F.concat_ws(" & ", "p_name", "p_brand"), 18).alias("slug"))


@query("x06_unshouted", "SELECT p_partkey, CASE WHEN p_type = upper(p_type) THEN upper(left(p_type, 1)) || lower(substr(p_type, 2)) ELSE p_type END AS kind FROM part")
def x06(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.unshouted(F.col("p_type")).alias("kind"))


_KEPT = rf"list_filter(string_split(regexp_extract(w, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{X.TRACKING}'))"
_NORMAL = rf"(SELECT page_id, html, CASE WHEN regexp_matches(o, '^https?://[^/]+/.+/$') THEN o[:-2] ELSE o END AS url FROM (SELECT page_id, html, regexp_extract(w, '^([^?]*)', 1) || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string({_KEPT}, '&') ELSE '' END AS o FROM (SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS w FROM pages)))"


@query("x07_normal_url", f"SELECT page_id, url FROM {_NORMAL}")
def x07(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.normal_url(F.col("url")).alias("url"))


@query("x08_dedupe_key", rf"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'title-only:' || n ELSE url || '|' || n END AS key FROM (SELECT page_id, url, trim(regexp_replace(lower('Page ' || page_id), '[^a-z0-9]+', ' ', 'g')) AS n FROM {_NORMAL})")
def x08(t: Tables) -> DataFrame:
    url = F.when(F.col("page_id") % 3 != 0, F.col("url"))
    return t.pages.select("page_id", X.dedupe_key(url, F.concat(F.lit("Page "), F.col("page_id").cast("string"))).alias("key"))


@query("x10_digest", "SELECT c_custkey, sha256(c_name || '|' || coalesce(nullif(c_mktsegment, 'BUILDING'), '') || '|' || c_nationkey) AS key FROM customer")
def x10(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", X.digest([F.col("c_name"), F.nullif("c_mktsegment", F.lit("BUILDING")), F.col("c_nationkey")], "|").alias("key"))


@query("x11_content_hash", "SELECT p_partkey, sha256(concat_ws(chr(31), p_name, p_brand, p_type, p_size::VARCHAR)) AS hash FROM part")
def x11(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.digest([F.col(c) for c in ("p_name", "p_brand", "p_type", "p_size")], "\u001f").alias("hash"))


@query("x16_redacted", "SELECT page_id, url || '&token=[REDACTED] Bearer [REDACTED] /bot[REDACTED]/send' AS text FROM pages")
def x16(t: Tables) -> DataFrame:
    k = F.col("page_id").cast("string")
    line = F.concat("url", F.lit("&token="), k, F.lit(" Bearer abc"), k, F.lit("== /bot"), k, F.lit(":x/send"))
    return t.pages.select("page_id", X.redacted(line).alias("text"))


@query("x17_hashtags", "SELECT p_partkey, array_to_string(regexp_extract_all(p_brand || ' ' || replace(p_name, ' ', ' #'), '#[A-Za-z0-9_]+'), ',') AS tags FROM part")
def x17(t: Tables) -> DataFrame:
    line = F.concat_ws(" ", "p_brand", F.replace("p_name", F.lit(" "), F.lit(" #")))
    return t.part.select("p_partkey", F.array_join(X.hashtags(line), ",").alias("tags"))


@query("x18_escaped", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS text FROM pages")
def x18(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.escaped(F.col("html")).alias("text"))


@query("x19_tokens", "SELECT doc_id, CAST(len(list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: len(w) > 2))) AS INTEGER) AS n FROM documents")
def x19(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(X.tokens(F.col("text"))).alias("n")).withColumn("n", F.when(F.col("n") >= 0, F.col("n")))


@query("x20_expanded", "SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' ') || CASE WHEN list_has_any(string_split(p_name, ' '), ['red', 'rose']) THEN ['red', 'rose'] ELSE [] END || CASE WHEN list_has_any(string_split(p_name, ' '), ['ring', 'band']) THEN ['ring', 'band'] ELSE [] END)), ' ') AS words FROM part")
def x20(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.array_join(F.sort_array(X.expanded(F.split("p_name", " "), [["red", "rose"], ["ring", "band"]])), " ").alias("words"))


@query("x21_listed_suffix", "SELECT p_partkey, CASE WHEN p_name LIKE '% ring' THEN 'ring' WHEN p_name LIKE '% widget' THEN 'widget' END AS suffix FROM part")
def x21(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.listed_suffix(F.col("p_name"), ["ring", "widget"]).alias("suffix"))


@query("x23_indian_mobile", "SELECT c_custkey, CASE WHEN c_custkey % 5 < 4 THEN '+919' || lpad(c_custkey::VARCHAR, 9, '0') END AS phone FROM customer")
def x23(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    number = F.concat(F.lit("9"), F.lpad(k.cast("string"), 9, "0"))
    heads = F.element_at(F.array(*map(F.lit, ("+91 ", "0091-", "0", "91", "12"))), (k % 5 + 1).cast("int"))
    return t.customer.select("c_custkey", X.indian_mobile(F.concat(heads, number)).alias("phone"))


@query("e02_labelled_location", r"SELECT page_id, nullif(regexp_extract(url, '^https?://([a-z]+)\.', 1), '') AS host, nullif(regexp_extract(url, '/(en|fr|es|de)(/|$)', 1), '') AS place FROM pages")
def e02(t: Tables) -> DataFrame:
    return t.pages.select("page_id", X.first(F.col("url"), r"^https?://([a-z]+)\.", 1).alias("host"), X.first(F.col("url"), "/(en|fr|es|de)(/|$)", 1).alias("place"))


@query("e03_years", "SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN least(p_size, 7) WHEN 1 THEN p_size WHEN 2 THEN 0 END AS INTEGER) AS least, CAST(CASE p_partkey % 4 WHEN 0 THEN greatest(p_size, 7) END AS INTEGER) AS most FROM part")
def e03(t: Tables) -> DataFrame:
    n = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 4
    line = F.when(kind == 0, F.concat(n, F.lit(" - 7 years"))).when(kind == 1, F.concat(F.lit("Minimum "), n, F.lit(" yrs"))).when(kind == 2, "Freshers welcome").otherwise("Experience welcome")
    return t.part.select("p_partkey", years(line).alias("y")).select("p_partkey", "y.least", "y.most")


@query("e05_contacts", r"SELECT doc_id, lower(nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), '')) AS email, nullif(regexp_extract(text, 'https?://[^\s)>\]]+'), '') AS link FROM documents")
def e05(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.email(F.col("text")).alias("email"), X.link(F.col("text")).alias("link"))


@query("e08_listed_words", "SELECT doc_id, array_to_string([w FOR w IN ['the', 'and', 'des', 'que', 'die'] IF regexp_matches(lower(text), '(^|[^a-z0-9])' || w || '([^a-z0-9]|$)')][1:3], ',') AS words FROM documents WHERE text IS NOT NULL")
def e08(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", F.array_join(X.listed_words(F.col("text"), ["the", "and", "des", "que", "die"], 3), ",").alias("words"))


@query("e09_first_label", "SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'red|rose') THEN 'warm' WHEN regexp_matches(p_name, 'blue|cold') THEN 'cool' ELSE 'plain' END AS mode FROM part")
def e09(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", X.first_label([("warm", "red|rose"), ("cool", "blue|cold")], F.col("p_name"), "plain").alias("mode"))


@query("e10_day_of", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 4 = 1 AND year(o_orderdate) < 2000 THEN INTERVAL 100 YEAR ELSE INTERVAL 0 YEAR END END::DATE AS day FROM orders")
def e10(t: Tables) -> DataFrame:
    kind, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    line = F.when(kind == 0, F.date_format(d, "d/M/yyyy")).when(kind == 1, F.date_format(d, "dd.MM.yy")).when(kind == 2, F.date_format(d, "yyyy-MM-dd")).otherwise("31-31-2024")
    return t.orders.select("o_orderkey", X.day_of(line).alias("day"))


@query("s06_anchors", r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS x FROM pages),
b AS (SELECT page_id, unnest(range(len(h)))::INTEGER AS pos, unnest(h) AS href, unnest(x) AS text FROM a)
SELECT * FROM b WHERE NOT regexp_matches(href, '(?i)^(#|javascript:|mailto:|tel:)')""")  # fmt: skip
def s06(t: Tables) -> DataFrame:
    return markup.anchors(t.pages, "page_id", "html")


@query("s08_elements", r"""
WITH a AS (SELECT page_id, regexp_extract_all(html, '(?is)<p\b[^>]*>(.*?)</p>', 1) AS x FROM pages)
SELECT page_id, unnest(range(len(x)))::INTEGER AS pos, trim(regexp_replace(unnest(x), '<[^>]*>', '', 'g')) AS text FROM a""")  # fmt: skip
def s08(t: Tables) -> DataFrame:
    return markup.elements(t.pages, "page_id", "html", "p")

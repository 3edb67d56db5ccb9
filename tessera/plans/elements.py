"""Queries of elements by position, over the whole pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.registry import Tables, query
from tessera.sources import elements as E


@query("s06_anchor_elements", r"""
SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*href="([^"]*)"', 1)) AS href FROM pages)
WHERE NOT regexp_matches(href, '(?i)^(#|javascript:|mailto:|tel:)') AND trim(href) <> '' GROUP BY ALL""")  # fmt: skip
def s06(t: Tables) -> DataFrame:
    found = E.anchors(E.elements(t.pages, "page_id", "html"), "page_id")
    return found.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query("s08_headed_paragraphs", r"""
WITH p AS (SELECT page_id, len(regexp_extract_all(html, '(?is)<p\b')) AS n, len(regexp_extract_all(regexp_replace(html, '(?is)<h1\b.*', ''), '(?is)<p\b')) AS before, len(regexp_extract_all(html, '(?is)<li\b')) AS items FROM (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g') AS html FROM pages))
SELECT page_id, n - before AS headed, before AS unheaded, items FROM p""")  # fmt: skip
def s08(t: Tables) -> DataFrame:
    """How many paragraphs of each page stand under a heading, how many before any, and how many items its lists have."""
    found = E.headed(E.elements(t.pages, "page_id", "html"), "page_id", F.col("tag").isin("p", "li"))
    paragraph, headed = F.col("tag") == "p", F.col("heading").isNotNull()
    counts = found.groupBy("page_id").agg(F.count_if(paragraph & headed).alias("headed"), F.count_if(paragraph & ~headed).alias("unheaded"), F.count_if(F.col("tag") == "li").alias("items"))
    return t.pages.select("page_id").join(counts, "page_id", "left").na.fill(0)

"""Queries that find terms of a table in whole texts, and judge texts by what was found. The terms are words of the benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import dictionary as D
from tessera.plans.registry import Tables, query

_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM benchmark),
v AS (SELECT w[1:1] AS words, 'one' AS label FROM b UNION ALL SELECT w[2:3], 'two' || item_id % 2 FROM b UNION ALL SELECT w[4:6], 'three' FROM b UNION ALL SELECT w[2:2], 'one' FROM b UNION ALL SELECT w[7:7], 'seven' || item_id % 3 FROM b),
i AS (SELECT words, list_sort(list(DISTINCT label)) AS labels FROM v GROUP BY words),
t AS (SELECT {key} AS id, regexp_extract_all(lower(coalesce({text}, '')), '[\p{{L}}\p{{N}}]+') AS w FROM {table}),
g AS (SELECT id, p, k, w[p + 1:p + k] AS words FROM t, range(1, 4) AS r(k), unnest(range(0, len(w) - k + 1)) AS u(p) WHERE len(w) >= k),
f AS (SELECT id, p, k, array_to_string(words, ' ') AS term, labels FROM g JOIN i USING (words)),
h AS (SELECT *, coalesce(max(p + k) OVER (PARTITION BY id ORDER BY p, k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM f),
found AS (SELECT id, p, k, term, labels FROM h WHERE reach < p + k),
s AS (SELECT id, list_sort(list(DISTINCT label)) AS labels FROM (SELECT id, unnest(labels) AS label FROM found) GROUP BY id)
"""


def _terms(t: Tables) -> DataFrame:
    w = D.tokens(F.col("text"))
    said = lambda a, n, label: F.struct(F.array_join(F.slice(w, a, n), " ").alias("term"), label.alias("label"))
    two, seven = F.concat(F.lit("two"), F.col("item_id") % 2), F.concat(F.lit("seven"), F.col("item_id") % 3)
    kinds = F.array(said(1, 1, F.lit("one")), said(2, 2, two), said(4, 3, F.lit("three")), said(2, 1, F.lit("one")), said(7, 1, seven))
    return t.benchmark.select(F.inline(kinds))


@query("e08_terms", _SQL.format(key="doc_id", text="text", table="documents") + "SELECT id AS doc_id, term, count(*) AS n, min(p) AS first FROM found GROUP BY id, term")
def e08_terms(t: Tables) -> DataFrame:
    found = D.hits(t.documents, "doc_id", "text", _terms(t))
    return found.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"), F.min("place").cast("long").alias("first"))


_RULES = [(1, ["three"], [], "passage"), (2, ["seven0", "two1"], ["two0"], "odd"), (3, ["seven1"], ["seven2"], "seven"), (4, ["one"], [], "word")]
_JUDGED = """SELECT {key}, CASE WHEN list_contains(l, 'three') THEN 'passage' WHEN list_has_all(l, ['seven0', 'two1']) AND NOT list_contains(l, 'two0') THEN 'odd'
    WHEN list_contains(l, 'seven1') AND NOT list_contains(l, 'seven2') THEN 'seven' WHEN list_contains(l, 'one') THEN 'word' ELSE 'none' END AS verdict
FROM (SELECT {key}, coalesce(labels, []) AS l FROM {table} LEFT JOIN s ON s.id = {key})"""


def _judged(t: Tables, texts: DataFrame, key: str, text: str) -> DataFrame:
    rules = t.spark.createDataFrame(_RULES, "rank int, needs array<string>, bars array<string>, verdict string")
    return D.ruled(D.labelled(texts, key, D.hits(texts, key, text, _terms(t))), key, rules, "none").select(key, "verdict")


@query("c01_by_terms", _SQL.format(key="doc_id", text="text", table="documents") + _JUDGED.format(key="doc_id", table="documents"))
def c01_by_terms(t: Tables) -> DataFrame:
    return _judged(t, t.documents, "doc_id", "text")


@query("c06_page_by_terms", _SQL.format(key="page_id", text="html", table="pages") + _JUDGED.format(key="page_id", table="pages"))
def c06_page_by_terms(t: Tables) -> DataFrame:
    return _judged(t, t.pages, "page_id", "html")

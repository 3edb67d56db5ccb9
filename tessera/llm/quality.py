"""Quality rules as a bitmask ledger, in DataFrame operations only.

Every rule is evaluated once, over the whole text. The ledger keeps its measurements and one bit a rule that fails. A policy is a
version and the set of bits that reject; applying one, or asking what each rule alone costs, reads the ledger and no text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WHITE, WORD_CLASS, cut, words


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measurements; true rejects."""

    name: str
    fails: str


#: The order gives the bits. Append only: ledgers that are kept would change their meaning.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_trigrams", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("many_repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("mostly_capitals", "2 * n_capitals > word_chars"),
    Rule("many_exclamations", "4 * n_exclamations > n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
)
BASE = ("too_few_words", "repeated_trigrams")
#: Policies by version. A newer one never changes an older one.
POLICIES = {1: BASE, 2: tuple(r.name for r in RULES)}
LATEST = max(POLICIES)


def mask_of(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    return sum(1 << i for i, r in enumerate(rules) if r.name in names)


def _windows() -> Column:
    """Hashes of the 3-word windows from _hashes, those of the words.

    No lambda here looks beyond its own arguments: one that indexes another array would have that array computed again for every
    element wherever the optimizer merges projections.
    """
    n = F.greatest(F.lit(0), F.size("_hashes") - 2)
    two = F.zip_with(F.slice("_hashes", 1, n), F.slice("_hashes", 2, n), lambda a, b: F.xxhash64(a, b))
    return F.zip_with(two, F.slice("_hashes", 3, n), lambda a, b: F.xxhash64(a, b))


def _covered() -> Column:
    """Words in 3-word windows that are found twice or more in the text, from _grams: hashes of windows with their positions, sorted.

    Equal windows are neighbours; each position adds the words that the one before it has not covered. Sorting keeps this at
    n log n for texts of any length. Two different windows of one text would have to share 64 bits to be counted by mistake.
    """
    n = F.greatest(F.lit(0), F.size("_grams") - 1)
    pairs = F.zip_with(F.slice("_grams", 1, n), F.slice("_grams", 2, n), lambda a, b: F.when(a["g"] == b["g"], F.array(a["i"], b["i"])))
    at = F.sort_array(F.array_distinct(F.flatten(F.filter(pairs, lambda x: x.isNotNull()))))
    return F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"].cast("long"),
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements of the text; null counts as empty. Columns of docs whose names clash are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda line: line.rlike(WORD_CLASS)
    return (
        docs.withColumn("_words", words(F.col(text)))
        .withColumn("_lines", F.filter(F.split(t, "\n"), has_word))
        .withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
        .withColumn("_grams", F.sort_array(F.transform(_windows(), lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
        .withColumns({
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.translate(t, WHITE, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_capitals": F.regexp_count(t, F.lit("[A-Z]")).cast("long"),
            "n_exclamations": F.regexp_count(t, F.lit("!")).cast("long"),
            "n_repeat_words": _covered(),
        })
        .drop("_words", "_lines", "_hashes", "_grams")
    )


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with measurements and fail_bits. Every row gets one; repeated rows are judged alike; an empty table gives an empty one."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measure(docs, text).withColumn("fail_bits", total)


def passes(mask: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")) == 0


def ablations(book: DataFrame, version: int = LATEST, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone, and that the policy would keep without it.

    One aggregation by the ledger's bits, of which there are at most 2**len(rules) patterns, whatever the number of documents.
    """
    names = POLICIES[version]
    mask = F.lit(mask_of(names, rules)).cast("long")
    patterns = book.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if r.name in names]))
    rows = patterns.select("bits", "n", each.alias("r")).select("bits", "n", "r.*")
    alone = F.col("bits") == F.col("bit")
    return rows.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("failed_alone"),
        F.sum(F.when(alone | (F.col("bits") == 0), F.col("n")).otherwise(0)).alias("kept_without"),
    )


def query(docs: DataFrame, version: int = LATEST) -> DataFrame:
    """A row a document: its measurements and whether the base rules and the policy let it pass.

    Null, empty and white texts have no words and fail the base rules; long texts are measured whole; repeated rows and null ids are
    judged like others; other columns play no part, whatever their names; an empty table gives an empty result.
    """
    return ledger(docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(mask_of(BASE))).alias("base_failed"),
        passes(mask_of(BASE) | mask_of(POLICIES[version])).alias("kept"),
        "fail_bits",
    )


def keep(docs: DataFrame, version: int = LATEST) -> DataFrame:
    """The rows of docs that the policy keeps, with their own columns, whatever their names.

    The ledger, with the rows, is written; the policy is a filter over it, so no rule is evaluated twice.
    """
    own = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    book = cut(ledger(held).drop("text"))
    return book.where(passes(mask_of(BASE) | mask_of(POLICIES[version]))).select(*own)


def ablation_query(docs: DataFrame, version: int = LATEST) -> DataFrame:
    """ablations() of the documents' ledger, which is written first."""
    return ablations(cut(ledger(docs.select("doc_id", "text")).drop("text")), version)


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g) WHERE n >= 2),
c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM d) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines,
        CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_capitals,
        CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS n_exclamations,
        CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines FROM m),
f AS (SELECT *, CAST(n_words < 50 AS INT) AS f0, CAST(100 * n_repeat_words > 50 * n_words AS INT) AS f1,
        CAST(10 * n_symbols > n_words AS INT) AS f2, CAST(2 * n_dup_lines > n_lines AS INT) AS f3,
        CAST(2 * n_capitals > word_chars AS INT) AS f4, CAST(4 * n_exclamations > n_words AS INT) AS f5,
        CAST(word_chars < 2 * n_words AS INT) AS f6, CAST(word_chars > 15 * n_words AS INT) AS f7 FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 + f1 > 0 AS base_failed,
  f0 + f1 + f2 + f3 + f4 + f5 + f6 + f7 = 0 AS kept,
  CAST(f0 + 2 * f1 + 4 * f2 + 8 * f3 + 16 * f4 + 32 * f5 + 64 * f6 + 128 * f7 AS BIGINT) AS fail_bits
FROM f
"""

_POLICY = [i for i, r in enumerate(RULES) if r.name in POLICIES[LATEST]]
ABLATION_SQL = f"""
WITH b AS (SELECT fail_bits & {mask_of(POLICIES[LATEST])} AS bits FROM ({SQL})),
r AS (SELECT * FROM (VALUES {", ".join(f"('{RULES[i].name}', {1 << i})" for i in _POLICY)}) AS v (rule, bit))
SELECT rule, CAST(sum(CASE WHEN bits & bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed,
  CAST(sum(CASE WHEN bits = bit THEN 1 ELSE 0 END) AS BIGINT) AS failed_alone,
  CAST(sum(CASE WHEN bits = bit OR bits = 0 THEN 1 ELSE 0 END) AS BIGINT) AS kept_without FROM b, r GROUP BY rule
"""

"""Vocabularies as tables: terms of any number are found in texts by one join on their first word, and verdicts follow from what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Words of a text in lower case: runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def term_index(terms: DataFrame) -> DataFrame:
    """head, words, labels: each term (term, label) by its first word; a term with several labels is one line. Terms without words go."""
    rows = terms.select(tokens(F.col("term")).alias("words"), "label").where(F.size("words") > 0)
    return rows.groupBy("words").agg(F.sort_array(F.collect_set("label")).alias("labels")).select(F.col("words")[0].alias("head"), "words", "labels")


def hits(texts: DataFrame, key: str, text: str, terms: DataFrame) -> DataFrame:
    """key, place (of the first word, from 0), n (words), term, labels: the terms found in each text, whole words only, in any case.

    The longest term wins: one that lies inside another found term goes, of those that overlap otherwise both stay. Keys are unique.
    Null texts have no words. The plan is the same for ten terms or a million; Spark broadcasts the terms where their size allows it.
    """
    index = term_index(terms)
    longest = index.agg(F.max(F.size("words"))).first()[0] or 1
    words = texts.select(F.col(key).alias("_key"), tokens(F.col(text)).alias("_words"))
    heads = words.select("_key", "_words", F.posexplode("_words").alias("place", "head"))
    ahead = heads.select("_key", "place", "head", F.slice("_words", F.col("place") + 1, longest).alias("ahead"))
    found = ahead.join(index, "head").where(F.slice("ahead", 1, F.size("words")) == F.col("words"))
    found = found.select("_key", "place", F.size("words").alias("n"), F.array_join("words", " ").alias("term"), "labels")
    before = Window.partitionBy("_key").orderBy("place", F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("place") + F.col("n")).over(before), F.lit(0))
    return found.withColumn("_reach", reach).where(F.col("_reach") < F.col("place") + F.col("n")).select(F.col("_key").alias(key), "place", "n", "term", "labels")


def labelled(texts: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """key, labels: the labels found in each text, in order; an empty list where there are none."""
    each = found.select(key, F.explode("labels").alias("label")).groupBy(key).agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return texts.select(key).join(each, key, "left").withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def ruled(sets: DataFrame, key: str, rules: DataFrame, default: str) -> DataFrame:
    """key, verdict, rule: by the first rule (rank, needs, bars, verdict) all of whose needs and none of whose bars are among a text's labels.

    Rules meet texts by their first need; without any rule that fits, or with none, it is the default and rule is null.
    """
    filed = rules.where(F.size("needs") > 0).withColumn("_need", F.col("needs")[0])
    met = sets.withColumn("_need", F.explode("labels")).join(filed, "_need")
    met = met.where((F.size(F.array_except("needs", "labels")) == 0) & ~F.coalesce(F.arrays_overlap("bars", "labels"), F.lit(False)))
    best = met.groupBy(key).agg(F.min(F.struct("rank", "verdict")).alias("_best"))
    return sets.select(key).join(best, key, "left").select(key, F.coalesce("_best.verdict", F.lit(default)).alias("verdict"), F.col("_best.rank").alias("rule"))

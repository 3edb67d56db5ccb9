"""Fuzzy duplicates among postings: seven kinds of evidence with weights, and candidates by what can reach the threshold at all."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.tables import held

# Hundredths of each kind of evidence, what is a duplicate, and from which share of common words texts count as similar.
WEIGHTS = {"email": 35, "phone": 30, "url": 35, "company": 30, "title": 20, "city": 10, "description": 20}
NEED = 50
SIMILAR = {"title": 70, "description": 50}
#: Pairs that one part of a block may list.
MEET = 500_000


def minimal_sets(weights: dict[str, int], need: int) -> list[tuple[str, ...]]:
    """The sets of evidence that reach `need` and of which no part does: whatever reaches it has one of them."""
    found: list[tuple[str, ...]] = []
    for n in range(1, len(weights) + 1):
        found += [c for c in combinations(weights, n) if sum(weights[x] for x in c) >= need and not any(set(f) <= set(c) for f in found)]
    return found


def _normal(text: Column) -> Column:
    return F.nullif(F.btrim(F.regexp_replace(F.lower(text.cast("string")), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def _words(text: Column) -> Column:
    """Distinct words of over two letters."""
    return F.array_distinct(F.filter(F.split(F.coalesce(_normal(text), F.lit("")), " "), lambda w: F.char_length(w) > 2))


def _prefixes(rows: DataFrame, field: str, per_cent: int) -> DataFrame:
    """_id, token: of each set of words the rarest ones, so many that two sets which share per_cent of their union share one of these."""
    words = rows.select("_id", F.explode(field).alias("token"), F.size(field).alias("n"))
    often = words.groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    place = F.row_number().over(Window.partitionBy("_id").orderBy("often", "token"))
    ranked = words.join(often, "token").withColumn("place", place)
    return ranked.where(F.col("place") * 100 <= F.col("n") * (100 - per_cent) + 100).select("_id", "token")


def _keys(rows: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """_id, set (its place among sets), key: the fields of each set that must be equal, with a rare word where a text must be similar."""
    prefixes = {f: held(_prefixes(rows, f, p)) for f, p in SIMILAR.items()}
    made = []
    for anchor in [None, *SIMILAR]:
        keys = []
        for i, evidence in enumerate(sets):
            if anchor == next((f for f in evidence if f in SIMILAR), None):  # a title has fewer words than a description
                equal = [f for f in evidence if f not in SIMILAR]
                known = reduce(lambda x, y: x & y, [F.col(f).isNotNull() for f in equal], F.lit(True))
                keys.append(F.when(known, F.struct(F.lit(i).alias("set"), F.xxhash64(F.lit(i), *equal, *(["token"] if anchor else [])).alias("key"))))
        if keys:
            known = rows.join(prefixes[anchor], "_id") if anchor else rows
            made.append(known.select("_id", F.inline(F.array_compact(F.array(*keys)))))
    return reduce(DataFrame.unionByName, made)


def _best(found: DataFrame, most: int) -> DataFrame:
    """Of rows (a, b, _key, cents) the first `most` of each a: greatest cents first, smaller keys before greater, each key once."""
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cents"), "_key"))
    return found.groupBy("a", "b", "_key").agg(F.max("cents").alias("cents")).withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def _by_equal_fields(records: DataFrame, few: DataFrame, most: int) -> DataFrame:
    """a, b, _key, cents: for each set of equal fields that reaches NEED the first `most` postings that have these fields as record a has.

    Who is best for a by equal fields alone has some set of them in common with a, and is among the first of those that have it.
    """
    fields = [f for f in WEIGHTS if f not in SIMILAR]
    sets = [c for n in range(1, len(fields) + 1) for c in combinations(fields, n) if sum(WEIGHTS[f] for f in c) >= NEED]
    both = lambda i, c: F.struct(F.lit(min(100, sum(WEIGHTS[f] for f in c))).alias("cents"), F.xxhash64(F.lit(i), *c).alias("key"), F.xxhash64(F.lit(-i - 1), *c).alias("check"))
    made = [F.when(reduce(lambda x, y: x & y, [F.col(f).isNotNull() for f in c]), both(i, c)) for i, c in enumerate(sets)]
    keyed = held(records.select("_id", F.inline(F.array_compact(F.array(*made)))))
    place = F.row_number().over(Window.partitionBy("key", "check").orderBy("_key"))
    heads = keyed.join(few, "_id").withColumn("_place", place).where(F.col("_place") <= most)
    heads = heads.select("key", "check", F.col("_id").alias("b"), "_key")
    return keyed.withColumnRenamed("_id", "a").join(heads, ["key", "check"]).select("a", "b", "_key", "cents")


def _text_sets(level: int) -> list[tuple[str, ...]]:
    """Sets with a similar text of which what beats a level has one: those that reach it at least, and the least that exceed it.

    Equal fields that exceed the level were looked up already; those that just reach it were too, but not what a text adds to them.
    """
    with_text = [c for n in range(1, len(WEIGHTS) + 1) for c in combinations(WEIGHTS, n) if any(f in SIMILAR for f in c)]
    over = [c for c in with_text if level < 100 and sum(WEIGHTS[f] for f in c) > level]
    least = [c for c in over if not any(set(o) < set(c) for o in over)]
    return sorted({*least, *(c for c in minimal_sets(WEIGHTS, level) if c in with_text)})


def _meetings(seekers: DataFrame, records: DataFrame) -> DataFrame:
    """a, b: records that may score `level` of a or more, with a similar text among the evidence; each pair once.

    seekers: a, level, limit. At 100, which is the most, only records with a posting before `limit` count. A large block is dealt over
    parts, each with some of its seekers against all.
    """
    sums = sorted({min(100, sum(WEIGHTS[f] for f in c)) for n in range(1, len(WEIGHTS) + 1) for c in combinations(WEIGHTS, n)})
    levels = {n: _text_sets(n) for n in sums if n >= NEED}
    sets = sorted({c for found in levels.values() for c in found})
    at = F.array(*[F.array(*[F.lit(n) for n in levels if c in levels[n]]) for c in sets])  # the levels at which a set is minimal
    keys = held(_keys(records, sets).distinct())
    left = keys.join(seekers, F.col("_id") == F.col("a")).where(F.array_contains(F.get(at, F.col("set")), F.col("level"))).select("a", "level", "limit", "key")
    left = held(left)
    sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("l")).join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("r")).where("r > 1"), "key")
    parts = held(sizes.select("key", F.ceil(F.col("l") * F.col("r") / MEET).cast("int").alias("parts")))
    left = left.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("a"), "parts").cast("int")).drop("parts")
    right = keys.join(parts, "key").join(records.select("_id", "least"), "_id")
    right = right.select("key", F.col("_id").alias("b"), "least", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    better = (F.col("a") != F.col("b")) & ((F.col("level") < 100) | (F.col("least") < F.col("limit")))
    return left.join(right, ["key", "part"]).where(better).select("a", "b", "level").distinct()


def _score(has: Column, other: Column) -> tuple[Column, Column]:
    """Hundredths and reasons of two records of normalised fields."""
    share = lambda f: F.size(F.array_intersect(has[f], other[f])) * 100 / F.greatest(F.size(F.array_union(has[f], other[f])), F.lit(1))
    both = lambda f: (F.size(has[f]) > 0) & (F.size(other[f]) > 0)
    held_ = {f: (both(f) & (share(f) >= SIMILAR[f])) if f in SIMILAR else F.coalesce(has[f] == other[f], F.lit(False)) for f in WEIGHTS}
    names = {f: F.lit(f"same {f}") for f in WEIGHTS} | {"title": F.lit("similar title"), "description": F.concat(F.lit("description overlap "), F.floor(share("description") + 0.5).cast("string"), F.lit("%"))}
    cents = sum((F.when(held_[f], w).otherwise(0) for f, w in WEIGHTS.items()), F.lit(0))
    return F.least(cents, F.lit(100)), F.array_compact(F.array(*[F.when(held_[f], names[f]) for f in WEIGHTS]))


def fuzzy_duplicates(postings: DataFrame, key: str, fields: dict[str, Column], most: int = 25) -> DataFrame:
    """key, other, score, reasons: of each posting the up to `most` others that score 0.5 or more, best first, smaller keys before greater.

    fields: a column for each kind of evidence of WEIGHTS; null and blank ones are no evidence. Keys are unique. Postings with the same
    evidence are one record, and records are compared: two postings of one record score what it scores with itself. A record brings in
    its first postings only, no more than anyone can take, so a group of copies of any size gives few rows a posting. Equal fields alone
    need no pairs; records are paired only where a similar text can give more than a record has by then.
    """
    made = [(_words(c) if f in SIMILAR else F.nullif(F.regexp_replace(c.cast("string"), r"\D", ""), F.lit("")) if f == "phone" else F.nullif(c.cast("string"), F.lit("")) if f == "url" else _normal(c)).alias(f) for f, c in fields.items()]
    rows = held(postings.select(F.col(key).alias("_key"), *made).withColumn("_id", F.xxhash64(*WEIGHTS)))
    # of a record's postings the smallest ones can be the best of others; the least `most` + 1 leave room for the posting itself
    first = F.row_number().over(Window.partitionBy("_id").orderBy("_key"))
    few = held(rows.select("_id", "_key").withColumn("_place", first).where(F.col("_place") <= most + 1).drop("_place"))
    records = held(rows.dropDuplicates(["_id"]).drop("_key").join(few.groupBy("_id").agg(F.min("_key").alias("least")), "_id"))
    has = records.select("_id", F.struct(*WEIGHTS).alias("x"))
    own = has.select(F.col("_id").alias("a"), F.col("_id").alias("b"), _score(F.col("x"), F.col("x"))[0].alias("cents")).where(F.col("cents") >= NEED)
    own = own.join(few.withColumnRenamed("_id", "b"), "b").select("a", "b", "_key", "cents")
    known = _best(_by_equal_fields(records, few, most + 1).unionByName(own), most + 1)
    a, b = has.select(F.col("_id").alias("a"), "x"), has.select(F.col("_id").alias("b"), F.col("x").alias("y"))
    score, reasons = _score(F.col("x"), F.col("y"))
    known = held(known.join(a, "a").join(b, "b").select("a", "b", "_key", score.alias("cents")))
    # what equal fields and copies give is a floor: with similar texts only those are looked for that can be better than it
    worst = known.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("cents").alias("level"), F.max_by("_key", F.struct(-F.col("cents"), "_key")).alias("limit"))
    worst = worst.where(F.col("n") > most).select("a", "level", "limit")
    seekers = records.select(F.col("_id").alias("a")).join(worst, "a", "left").select("a", F.coalesce("level", F.lit(NEED)).alias("level"), "limit")
    pairs = _meetings(held(seekers), records)
    scored = pairs.join(a, "a").join(b, "b").select("a", "b", "level", score.alias("cents")).where(F.col("cents") >= F.col("level"))
    found = scored.join(few.withColumnRenamed("_id", "b"), "b").select("a", "b", "_key", "cents")
    best = held(_best(known.unionByName(found), most + 1))
    best = best.join(a, "a").join(b, "b").select("a", "cents", "_key", reasons.alias("reasons"))
    best = best.groupBy("a").agg(F.sort_array(F.collect_list(F.struct((-F.col("cents")).alias("cents"), F.col("_key").alias("other"), "reasons"))).alias("best"))
    chosen = rows.select("_key", F.col("_id").alias("a")).join(best, "a")
    others = F.slice(F.filter("best", lambda x: x["other"] != F.col("_key")), 1, most)
    return chosen.select(F.col("_key").alias(key), F.inline(others)).select(key, "other", (-F.col("cents") / 100).alias("score"), "reasons")

"""The listings most like each listing, for all listings at once: the first few of each combination of facets, best ones merged, no pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.alerts import MEET, matches
from tessera.operators.tables import held, spread

# Points of a word of the title, of each skill and of all of them at most, of a word of the place, of the sector, of a
# featured listing; what makes a listing related; letters that a word of a title or place has more than.
TITLE, SKILL, SKILLS, PLACE, SECTOR, FEATURED = 35, 10, 30, 20, 8, 2
LEAST, SHORT = 25, 3


def _normal(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _long_words(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(text, " "), lambda w: F.char_length(w) > SHORT)))


def _shown(rows: DataFrame, asked: str, said: str) -> DataFrame:
    """said, and the terms of all `asked` that it contains, in order: distinct terms against distinct texts, by an inverted index."""
    terms = rows.select(F.explode(asked).alias("term")).where("term <> ''").distinct()
    terms = terms.select("term", F.array("term").alias("keywords"), F.lit(None).cast("array<string>").alias("fields"))
    texts = rows.select(F.col(said).alias("said")).distinct().withColumn("text_id", F.xxhash64("said"))
    found = matches(terms, texts, "term", "text_id", "said").groupBy("text_id").agg(F.array_sort(F.collect_set("term")).alias(f"{said}_shows"))
    return texts.join(found, "text_id", "left").select(F.col("said").alias(said), F.coalesce(f"{said}_shows", F.array().cast("array<string>")).alias(f"{said}_shows"))


def _subsets(terms: Column, most: int) -> Column:
    """Every choice of up to `most` of the sorted terms, as how many they are and their names joined; normal terms have no '|'."""
    # of each choice the place of its last term, after which more may be taken
    chosen = F.transform(terms, lambda w, i: F.struct(i.alias("at"), w.alias("of")))
    found = F.array(F.struct(F.lit(0).alias("n"), F.lit("").alias("of")))
    for n in range(1, most + 1):
        many = F.lit(n).alias("n")  # bound now; a lambda's second parameter would be the index
        found = F.concat(found, F.transform(chosen, lambda c: F.struct(many, c["of"].alias("of"))))  # noqa: B023
        if n < most:
            further = lambda c: F.transform(F.slice(terms, c["at"] + 2, F.size(terms)), lambda w, j: F.struct((c["at"] + 1 + j).alias("at"), F.concat(c["of"], F.lit("|"), w).alias("of")))
            chosen = F.flatten(F.transform(chosen, further))
    return found


def _combinations(rows: DataFrame, keep: list[str], titles: str, places: str, some: str) -> DataFrame:
    """keep, combination, points: each way to take one word of the title or none, one of the places or none, one choice of skills
    (`some`) and the sector or not, that a featured listing at least reaches LEAST with."""
    one = lambda c: F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col(c)))
    each = rows.select(*keep, "sector", F.col(places), F.col(some), one(titles).alias("_t")).select(*keep, "sector", "_t", F.col(some), one(places).alias("_p"))
    each = each.select(*keep, "sector", "_t", "_p", F.explode(some).alias("_s"))
    each = each.select("*", F.explode(F.when(F.col("sector").isNull(), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("_own"))
    points = F.when(F.col("_t").isNotNull(), TITLE).otherwise(0) + F.when(F.col("_p").isNotNull(), PLACE).otherwise(0) + F.col("_s.n") * SKILL + F.when(F.col("_own"), SECTOR).otherwise(0)
    named = F.xxhash64(F.coalesce("_t", F.lit("")), F.coalesce("_p", F.lit("")), "_s.of", "_own", F.when(F.col("_own"), F.col("sector")))
    return each.select(*keep, named.alias("combination"), points.alias("points")).where(F.col("points") + FEATURED >= LEAST)


def related(listings: DataFrame, key: str, title: Column, skills: Column, text: Column, place: Column, sector: Column, featured: Column, most: int = 4) -> DataFrame:
    """key, other, score: of each listing the up to `most` others with 25 points or more, best first, smaller keys before greater.

    35 for any word of its title over three letters that the other's title contains, 10 for each of its skills in the other's text, 30 at
    most, 20 for a word of its place likewise, 8 for the same sector, 2 for a featured one. Keys are unique; nulls say nothing, and a null
    sector is no sector. No pairs are listed: of those that show a combination of facets (a word of the title, a word of the place, up to
    three skills, the sector), which gives its points, the first most + 1, featured ones first, are enough. Whoever is among the best of
    a listing is among the first ones of just the facets that it shares with it. Listings that ask or show the same are one.
    """
    asked = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(skills, F.array().cast("array<string>")), _normal), lambda s: s != "")))
    rows = listings.select(F.col(key).alias("_key"), _normal(title).alias("title"), _normal(place).alias("place"), _normal(text).alias("text"), asked.alias("skills"), sector.alias("sector"), F.coalesce(featured, F.lit(False)).alias("featured"))
    rows = held(rows.withColumns({"titles": _long_words(F.col("title")), "places": _long_words(F.col("place"))}))
    for terms, said in (("titles", "title"), ("places", "place"), ("skills", "text")):
        rows = rows.join(_shown(rows.select(terms, said), terms, said), said)
    asks, shows = ["titles", "places", "skills", "sector"], ["title_shows", "place_shows", "text_shows", "sector", "featured"]
    rows = held(rows.withColumns({"x": F.xxhash64(F.lit(0), *asks), "y": F.xxhash64(F.lit(1), *[c for c in shows if c != "featured"])}).select("_key", "x", "y", *asks, *[c for c in shows if c != "sector"]))
    seekers = held(rows.dropDuplicates(["x"]).select("x", "sector", "titles", "places", _subsets(F.col("skills"), SKILLS // SKILL).alias("some")))
    # only choices of skills that someone asks for are made of what a listing shows
    wanted = held(seekers.select(F.explode("some").alias("some")).distinct())
    chosen = rows.select("text_shows").distinct().select("text_shows", F.explode(_subsets(F.col("text_shows"), SKILLS // SKILL)).alias("some"))
    chosen = held(chosen.join(wanted, "some", "left_semi").groupBy("text_shows").agg(F.collect_list("some").alias("some")))
    ahead = [F.desc("featured"), F.asc("_key")]
    few = rows.withColumn("_place", F.row_number().over(Window.partitionBy("y").orderBy(*ahead))).where(F.col("_place") <= most + 1)
    few = few.select("_key", "sector", "featured", "title_shows", "place_shows", "text_shows").join(chosen, "text_shows")
    shown = _combinations(spread(few), ["_key", "featured"], "title_shows", "place_shows", "some").drop("points")
    first = F.row_number().over(Window.partitionBy("combination").orderBy(*ahead))
    shown = shown.withColumn("_place", first).where(F.col("_place") <= most + 1)
    shown = held(shown.groupBy("combination").agg(F.collect_list(F.struct("_key", "featured")).alias("first")))
    asked = held(_combinations(spread(seekers), ["x"], "titles", "places", "some"))
    # what many ask for is dealt over parts; no more than one combination in MEET asked ones is
    parts = F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("parts")
    many = held(asked.groupBy("combination").agg(parts).where("parts > 1"))
    asked = asked.join(F.broadcast(many), "combination", "left").withColumn("part", F.pmod(F.xxhash64("x"), F.coalesce("parts", F.lit(1)))).drop("parts")
    shown = shown.join(F.broadcast(many), "combination", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    met = asked.join(shown, ["combination", "part"]).select("x", "points", F.inline("first"))
    score = F.col("points") + F.when(F.col("featured"), FEATURED).otherwise(0)
    scored = met.select("x", "_key", score.alias("score")).where(F.col("score") >= LEAST).groupBy("x", "_key").agg(F.max("score").alias("score"))
    place_of = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("score"), "_key"))
    best = scored.withColumn("_place", place_of).where(F.col("_place") <= most + 1)
    best = best.groupBy("x").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("score"), F.col("_key").alias("other")))).alias("best"))
    others = F.slice(F.filter("best", lambda b: b["other"] != F.col("_key")), 1, most)
    return rows.select("_key", "x").join(best, "x").select(F.col("_key").alias(key), F.inline(others)).select(key, "other", (-F.col("score")).alias("score"))

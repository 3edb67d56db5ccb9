"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame operations only.

A sketch keeps every shingle hash below a fixed fraction of the hash range. So sketches of any two texts, however unequal in length,
hold the same hashes of what they share: the sketch of a union is the union of sketches, and containment can be read off either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, words

SHINGLE = 5
#: Hashes have HASH_BITS bits; those below 1/SCALE of the range are kept.
HASH_BITS, SCALE = 48, 8
#: Documents a bucket of the order by id, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS, QUANTILES = 64, 100_000, 64


def _hash(*parts: Column) -> Column:
    return F.xxhash64(*parts)


def with_shingles(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with an array of the hashes of all shingles of a text, none for null.

    A text of fewer than SHINGLE words has one shingle of them all; one without words has none. No lambda looks beyond its arguments.
    """
    n = F.greatest(F.lit(0), F.size("_h") - (SHINGLE - 1))
    two = F.zip_with(F.slice("_h", 1, n + 2), F.slice("_h", 2, n + 2), lambda a, b: _hash(a, b))
    five = F.zip_with(F.slice("_two", 1, n), F.slice("_two", 3, n), lambda a, b: _hash(a, b))
    five = F.zip_with(five, F.slice("_h", SHINGLE, n), lambda a, b: F.shiftrightunsigned(_hash(a, b), 64 - HASH_BITS))
    whole = F.array(F.shiftrightunsigned(F.xxhash64(F.concat_ws(" ", "_w")), 64 - HASH_BITS))
    return (
        df.withColumn("_w", words(F.lower(F.col(text))))
        .withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
        .withColumn("_two", F.when(F.size("_h") >= SHINGLE, two).otherwise(F.array().cast("array<bigint>")))
        .withColumn(out, F.when(F.size("_h") >= SHINGLE, five).when(F.size("_w") > 0, whole).otherwise(F.array().cast("array<bigint>")))
        .drop("_w", "_h", "_two")
    )


def _kept(low: str | Column, hashes: str | Column) -> Column:
    return F.when(F.size(low) > 0, F.sort_array(F.array_distinct(low))).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<bigint>"))


def _low(hashes: str | Column) -> Column:
    return F.filter(hashes, lambda h: h < (1 << HASH_BITS) // SCALE)


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with a sorted array of the kept hashes of a non-null text.

    Where no hash falls below the threshold, the smallest stands in, so that only texts without words have an empty sketch.
    """
    return with_shingles(df, text, "_five").withColumn("_low", _low("_five")).withColumn(out, _kept("_low", "_five")).drop("_five", "_low")


def stand_in(sketch: str) -> Column:
    """Whether a sketch holds only the hash that stands in for those below the threshold."""
    return (F.size(sketch) == 1) & (F.get(sketch, F.lit(0)) >= (1 << HASH_BITS) // SCALE)


def likeness(a: str, b: str) -> Column:
    """Share of the union that both have; 1 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 1.0).otherwise(both / union).cast("double")


def shared(a: str, b: str) -> Column:
    """Share of the smaller set of hashes that the other has; 1 where it is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / least).cast("double")


def containment(a: str, b: str) -> Column:
    """Share of the smaller sketch that the other has; null where a hash only stands in, as a longer text need not keep it."""
    return F.when(~(stand_in(a) | stand_in(b)), shared(a, b))


def merged(sketches: Column) -> Column:
    """The sketch of all texts of a group, from an aggregate's array of sketches. A hash stands in only where none is below the threshold."""
    every = F.flatten(sketches)
    return _kept(_low(every), every)


def printed(sketch: str) -> Column:
    return F.concat_ws(",", F.transform(sketch, lambda h: F.lower(F.hex(h))))


def with_next(df: DataFrame, key: Column, values: list[str]) -> DataFrame:
    """df with next_<value> for each value: that of the row after it in descending order of key, after the last that of the first.

    Rows are put in buckets that follow the order: quantiles of the key, each divided evenly. The first row of each bucket is also
    put, as a guest, behind the last one of the bucket before it. So each row meets the next within its bucket, in one shuffle.
    What is broadcast has a row a bucket, MOST_BUCKETS at most. Rows without a key come last; tied keys are ordered by the values.
    """
    df = df.withColumn("_k", F.coalesce(key.cast("long"), F.lit(-(2**63))))
    every = [i / QUANTILES for i in range(QUANTILES + 1)]
    about = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_k", every, 10_000).alias("q")).first()
    if not about["n"]:
        return df.drop("_k").withColumns({f"next_{v}": F.col(v) for v in values})
    bounds = sorted(set(about["q"]))
    parts = max(1, min(MOST_BUCKETS, about["n"] // BUCKET_ROWS) // len(bounds))
    # the quantile that a key is in, and its place between that and the one before
    at = F.least(F.size(F.filter(F.lit(bounds), lambda b: b < F.col("_k"))), F.lit(len(bounds) - 1))
    df = df.withColumn("_q", at)
    low = F.element_at(F.lit([bounds[0], *bounds[:-1]]), F.col("_q") + 1).cast("double")
    high = F.element_at(F.lit(bounds), F.col("_q") + 1).cast("double")
    share = F.when(high > low, (F.col("_k").cast("double") - low) / (high - low)).otherwise(0.0)
    inner = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor(share * parts)))
    df = df.withColumn("_bucket", (F.col("_q") * parts + inner).cast("long"))
    heads = df.groupBy("_bucket").agg(F.max("_k").alias("_head"))
    up, every_row = Window.orderBy("_bucket"), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = cut(heads.select("_head", F.lead("_bucket").over(up).alias("_above"), F.min("_bucket").over(every_row).alias("_lowest")))
    guests = F.broadcast(heads.select(F.col("_head").alias("_k"), F.coalesce("_above", "_lowest").alias("_to"), F.col("_above").isNull().alias("_wraps")))
    own = F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("_to").alias("b"), F.when(F.col("_wraps"), 2).otherwise(1).alias("guest"))
    placed = df.join(guests, "_k", "left").withColumn("_p", F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, guest))))
    placed = placed.select(*[c for c in df.columns if c not in ("_bucket", "_q")], F.col("_p.b").alias("_bucket"), F.col("_p.guest").alias("_guest"))
    order = Window.partitionBy("_bucket").orderBy(F.col("_guest") == 2, F.col("_k").desc(), *values)
    following = placed.withColumns({f"next_{v}": F.lead(v).over(order) for v in values})
    return following.where("_guest = 0").drop("_k", "_bucket", "_guest")


def query(docs: DataFrame) -> DataFrame:
    """A row a document: fingerprints of its text and of its edited text, whose last third is the beginning of the next document.

    Null texts count as empty; equal texts have equal fingerprints; a table of one row follows itself. Containment is read off the
    sketches, and where one of them is only a stand-in, off all shingles.
    """
    base = with_sketch(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sketch")
    rows = with_next(base, F.col("doc_id"), ["text", "sketch"]).withColumn("n_chars", F.char_length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substring("next_text", F.lit(1), third))
    rows = with_sketch(rows.withColumn("edited", edited), "edited", "edited_sketch")
    rows = rows.withColumn("_few", stand_in("sketch") | stand_in("edited_sketch") | stand_in("next_sketch")).withColumn("edited_sha256", F.sha2("edited", 256))
    for text in ("text", "edited", "next_text"):  # shingles of few rows: short texts and what they are held against
        rows = with_shingles(rows.withColumn(text, F.when(F.col("_few"), F.col(text))), text, f"_all_{text}").withColumn(f"_all_{text}", F.array_distinct(f"_all_{text}")).drop(text)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", printed("sketch").alias("fingerprint"), printed("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"), likeness("sketch", "next_sketch").alias("near_next"),
        F.coalesce(containment("sketch", "edited_sketch"), shared("_all_text", "_all_edited")).alias("contained_edited"),
        F.coalesce(containment("sketch", "next_sketch"), shared("_all_text", "_all_next_text")).alias("contained_next"),
    )

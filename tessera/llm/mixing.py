"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

A document's place in its source's order is a hash of its id and text. The words of each source are summed by hash bucket; the bucket where
the running sum crosses the source's budget is split into finer buckets, and only that one, level by level. What results is one
threshold a source: documents below it are taken, by a filter. Nothing is sorted but a source's 1,024 bucket sums, and a smaller
budget takes a subset of what a larger one takes. Where rows with equal id and text meet at the boundary, as many of them are taken
as fit, by a second threshold on row numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut

#: Each level refines the boundary bucket of the one before into this many bits' worth of buckets, until it is one row.
BITS, PLACE_BITS = 10, 60
#: No document is repeated more often.
MOST = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def place() -> Column:
    """0 to 2**60 - 1, by doc_id and text; rows that have both in common share it."""
    said = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def numbered(row: Column) -> Column:
    """A place by the number of a row."""
    return F.shiftrightunsigned(F.xxhash64(row), 64 - PLACE_BITS)


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target of each source in sized (source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating; their targets share all words by weight, but stop at MOST times the
    source's own words, and the rest is shared by weight among the others. In ascending order of limit over weight the full sources
    come first, so running sums decide each row. This table has one row a source; its two orders are the only ones taken here.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("weight", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1)
    limit = F.col("source_size").cast("decimal(38,0)") * MOST
    order = Window.orderBy((F.col("source_size") * 6 / F.col("weight")).cast("decimal(38,0)"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    return (
        ranked.withColumns({
            "_left": (F.sum("source_size").over(every) - F.coalesce(F.sum("source_size").over(before) * MOST, F.lit(0))),
            "_weights": F.sum("weight").over(after),
            "_full_before": F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        })
        .withColumn("_full", limit * F.col("_weights") <= F.col("_left").cast("decimal(38,0)") * F.col("weight"))
        .withColumns({
            "_spent": F.coalesce(F.sum(F.when(F.col("_full"), F.col("source_size"))).over(every), F.lit(0)) * MOST,
            "_open": F.sum(F.when(~F.col("_full"), F.col("weight"))).over(every),
            "_all": F.sum("source_size").over(every),
        })
        .select(
            "source", "source_size",
            F.when(F.col("_full"), (F.col("source_size") * MOST).cast("double"))
            .otherwise((F.col("weight") * (F.col("_all") - F.col("_spent"))).cast("double") / F.col("_open").cast("double")).alias("target"),
        )
    )


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """s (a source), threshold, tie, left: rows of sized (source, place, size) with a place below the threshold hold about `budget` words.

    Null sources meet as equals. A level reads sized, keeps the bucket that the level before left open, and sums it by finer bucket.
    If several rows share the boundary place, that is the tie, and left is what the budget has for them; both are null otherwise.
    """
    # the open bucket of each source: its place above (in units of the level), words taken below it
    open_ = budgets.select(F.col("source").alias("s"), F.col("budget"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    sized = sized.where("size > 0")
    upto = F.col("below") + F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    # the first bucket that passes the budget; the last where none does
    fits = F.col("upto") <= F.col("budget")
    first = F.min_by(F.struct("bucket", "upto", "size", "rows"), F.struct(fits, F.when(fits, -F.col("bucket")).otherwise(F.col("bucket"))))
    for level in range(1, PLACE_BITS // BITS + 1):
        shift = PLACE_BITS - BITS * level
        fine = sized.withColumn("bucket", F.shiftright("place", shift))
        if level > 1:
            inside = F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("bucket", BITS) == F.col("prefix"))
            fine = fine.join(open_.select("s", "prefix"), inside)
        sums = fine.groupBy("source", "bucket").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
        sums = sums.join(open_.select("s", "budget", "prefix", "below"), F.col("source").eqNullSafe(F.col("s"))).withColumn("upto", upto)
        open_ = cut(
            sums.groupBy("source", "budget").agg(first.alias("b"))
            .select(F.col("source").alias("s"), "budget", F.col("b.bucket").alias("prefix"), (F.col("b.upto") - F.col("b.size")).alias("below"), F.col("b.upto").alias("upto"), F.col("b.rows").alias("rows"))
        )
        if not open_.where((F.col("rows") > 1) & ~fits).limit(1).count():
            break
    tied = (F.col("rows") > 1) & ~fits
    nearer = ~tied & (F.col("upto") - F.col("budget") < F.col("budget") - F.col("below"))
    end = F.col("prefix") + F.when(fits | nearer, 1).otherwise(0)
    return open_.select("s", F.shiftleft(end, shift).alias("threshold"), F.when(tied, F.col("prefix")).alias("tie"), F.when(tied, F.col("budget") - F.col("below")).alias("left"))


def measured(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"size": word_count(F.col("text")), "place": place()})


def plan(sized: DataFrame) -> DataFrame:
    """s (the source), source_size, target, whole, threshold, tie, left: a row a source.

    A source whose target is r times its words gives every document floor(r) times, and those below its threshold once more.
    """
    goal = cut(targets(sized))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("whole", F.least(whole, F.lit(MOST).cast("long")))
    limits = thresholds(sized, goal.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    return cut(goal.join(limits, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "s"))


def split_ties(tied: DataFrame) -> DataFrame:
    """s and row_limit: of the rows in tied (source, size, left, row), those whose numbered(row) is below it are taken."""
    budgets = tied.groupBy("source").agg(F.first("left").alias("budget"))
    return cut(thresholds(tied.select("source", numbered(F.col("row")).alias("place"), "size"), budgets).select("s", F.col("threshold").alias("row_limit")))


def copies(below: Column) -> Column:
    return F.col("whole") + ((F.col("whole") < MOST) & F.coalesce(below, F.lit(False))).cast("long")


def query(docs: DataFrame) -> DataFrame:
    """A row a document.

    Null, empty and white texts have no words and are taken as none. Rows that share id and text, null ids too, are dealt by number,
    as many as the budget has room for. Long texts are counted where they lie. Other columns play no part, whatever their names. An
    empty table gives an empty result. Which of equal rows are taken may change between runs, how many may not.
    """
    sized = cut(measured(docs.select("doc_id", "source", "text")).drop("text").withColumn("row", F.monotonically_increasing_id()))
    rows = sized.join(plan(sized), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    tied = rows.where(F.col("place") == F.col("tie"))
    if tied.limit(1).count():
        rows = rows.join(split_ties(tied), F.col("source").eqNullSafe(F.col("s")), "left")
        once_more = (F.col("place") < F.col("threshold")) | ((F.col("place") == F.col("tie")) & (numbered(F.col("row")) < F.col("row_limit")))
    else:
        once_more = F.col("place") < F.col("threshold")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(once_more)).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Texts are joined with one row a source, so they need no shuffle where those are few."""
    sized = cut(measured(docs.select("doc_id", "source", "text")).drop("text"))
    goals = plan(sized)
    own = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("source").alias("_source"), place().alias("place"))
    rows = rows.join(goals, F.col("_source").eqNullSafe(F.col("s"))).drop("s")
    tied = F.coalesce(F.col("place") == F.col("tie"), F.lit(False))
    taken = rows.where(~tied).select("_row", copies(F.col("place") < F.col("threshold")).alias("_copies"))
    if goals.where("tie IS NOT NULL").limit(1).count():
        # these rows are written with their numbers, so that a task that runs again finds the same ones
        equal = cut(rows.where(tied).withColumn("row", F.monotonically_increasing_id()))
        limits = split_ties(equal.select(F.col("_source").alias("source"), word_count(F.col("_row.text")).alias("size"), "left", "row"))
        equal = equal.join(limits, F.col("_source").eqNullSafe(F.col("s")), "left")
        taken = taken.unionByName(equal.select("_row", copies(numbered(F.col("row")) < F.col("row_limit")).alias("_copies")))
    return taken.select(F.explode(F.array_repeat("_row", F.col("_copies").cast("int"))).alias("_row")).select(*own)


SQL = r"""
WITH t AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        CAST('0x' || substr(md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))), 1, 15) AS BIGINT) AS place, row_number() OVER () AS rn FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size FROM t GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total,
        coalesce(sum(source_size) OVER (ORDER BY source_size * 6 // weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(weight) OVER (ORDER BY source_size * 6 // weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM w),
f AS (SELECT *, 3 * source_size * weights <= (total - 3 * before) * weight AS is_full FROM o),
g AS (SELECT *, coalesce(sum(CASE WHEN is_full THEN 3 * source_size END) OVER (), 0) AS spent, sum(CASE WHEN NOT is_full THEN weight END) OVER () AS open FROM f),
r AS (SELECT source, CAST(source_size AS BIGINT) AS source_size,
        CASE WHEN is_full THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(weight * (total - spent) AS DOUBLE) / CAST(open AS DOUBLE) END AS target FROM g),
k AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM r),
c AS (SELECT t.*, k.source_size, k.target, k.whole, k.target - k.whole * k.source_size AS budget,
        sum(size) OVER (PARTITION BY t.source ORDER BY place, rn ROWS UNBOUNDED PRECEDING) AS upto FROM t JOIN k ON t.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN whole < 3
    AND (upto <= budget OR (upto - size <= budget AND upto - budget < budget - (upto - size))) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""

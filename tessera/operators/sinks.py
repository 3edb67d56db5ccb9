"""Changes to stored tables, as DataFrames that give the table after the change. A caller writes them, or appends with save()."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of incoming replace stored ones with the same key; the rest stay. incoming has one row a key."""
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def moved(stored: DataFrame, actions: DataFrame, key: str, action: str, state: str, states: dict[str, str]) -> DataFrame:
    """State of the rows with an action that states knows; other rows and unknown actions change nothing. actions has one row a key."""
    to = F.coalesce(*[F.when(F.col(action) == a, F.lit(s)) for a, s in states.items()], F.col(state))
    return stored.join(actions, key, "left").withColumn(state, to).drop(action)


def soft_deleted(stored: DataFrame, gone: DataFrame, key: str, state: str, flag: str) -> DataFrame:
    """Rows whose key is in gone stay, with the state Deleted and the flag off."""
    marks = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    rows = stored.join(marks, key, "left")
    gone_too: Column = F.col("_gone").isNotNull()
    return rows.withColumns({state: F.when(gone_too, F.lit("Deleted")).otherwise(F.col(state)), flag: F.col(flag) & ~gone_too}).drop("_gone")


def changed(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of incoming that are new or differ from the stored ones, by a digest of the columns in which null and absent are alike."""
    digest = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    old = stored.select(key, digest.alias("_old"))
    rows = incoming.withColumn("_new", digest).join(old, key, "left")
    return rows.where(~F.col("_new").eqNullSafe(F.col("_old"))).drop("_new", "_old")


def save(rows: DataFrame, path: str, form: str = "parquet") -> None:
    """Append rows to a table of files. CSV has a header, quotes where needed, quotes doubled inside quotes."""
    out = rows.write.mode("append")
    if form == "csv":
        out.options(header=True, quote='"', escape='"', emptyValue="", lineSep="\n").csv(path)
    else:
        out.format(form).save(path)


def reviewed(old: DataFrame, new: DataFrame, key: str, link: str, official: Column) -> DataFrame:
    """New values over old ones unless empty; an official link is never replaced by another. `official` tests the column `link` of either side."""
    values = [c for c in old.columns if c not in (key, link)]
    stored = old.withColumn("_official", F.coalesce(official, F.lit(False)))
    fresh = new.withColumn("_better", F.coalesce(official, F.lit(False))).select(key, "_better", *[F.col(c).alias(f"_new_{c}") for c in [*values, link]])
    blank = lambda c: F.when(F.btrim(F.col(f"_new_{c}").cast("string")) != "", F.col(f"_new_{c}"))
    kept = F.when(F.coalesce("_official", F.lit(False)) & ~F.coalesce("_better", F.lit(False)), F.col(link)).otherwise(F.coalesce(blank(link), F.col(link)))
    return stored.join(fresh, key, "full_outer").select(key, *[F.coalesce(blank(c), F.col(c)).alias(c) for c in values], kept.alias(link))


def claimed(ledger: DataFrame, key: str, state: str, leased: str, now: Column, lease_seconds: int, most: int, worker: str) -> DataFrame:
    """The ledger after a worker's claim: rows whose lease ran out are uncertain and stay unsent; the first `most` queued ones are the worker's.

    Sent and uncertain rows are never claimed again, so that nothing is sent twice.
    """
    expired = (F.col(state) == "publishing") & (F.unix_timestamp(now) - F.unix_timestamp(leased) > lease_seconds)
    rows = ledger.withColumn(state, F.when(expired, "uncertain").otherwise(F.col(state)))
    mine = rows.where(F.col(state) == "queued").orderBy(key).limit(most).select(key, F.lit(worker).alias("_worker"))
    out = rows.join(mine, key, "left")
    taken = F.col("_worker").isNotNull()
    return out.withColumn(state, F.when(taken, "publishing").otherwise(F.col(state))).withColumn(leased, F.when(taken, now).otherwise(F.col(leased))).withColumnRenamed("_worker", "worker")


def insertable(stored: DataFrame, rows: DataFrame, minimal: list[str]) -> DataFrame:
    """rows as they go into a table: all columns where it has them all, else the minimal ones only; what a row doesn't say is null."""
    types = dict(zip(stored.columns, [f.dataType for f in stored.schema], strict=True))
    taken = rows.columns if set(rows.columns) <= set(types) else minimal
    return rows.select(*[(F.col(c) if c in taken else F.lit(None)).cast(t).alias(c) for c, t in types.items()])


def seeded(stored: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """stored with the seeds' columns set anew and its other ones kept, and with seeds that it lacks. seeds has one row a key."""
    old = stored.drop(*[c for c in seeds.columns if c != key])
    known = seeds.select(key).withColumn("_seeded", F.lit(True))
    rest = stored.join(known, key, "left_anti")
    return seeds.join(old, key, "left").select(*stored.columns).unionByName(rest)


def next_batch(items: DataFrame, done: DataFrame, key: str, budget: int) -> DataFrame:
    """The first `budget` items in order of the key that aren't done: a run that stops goes on from what it wrote to done."""
    return items.join(done.select(key), key, "left_anti").orderBy(key).limit(budget)


def numbered_pages(rows: DataFrame, key: str, size: int = 1000, most: int = 50_000) -> DataFrame:
    """The first `most` rows in order of the key, with page. Only those rows are numbered, so that the one window is bounded."""
    first = rows.orderBy(key).limit(most)
    return first.withColumn("page", F.floor((F.row_number().over(Window.orderBy(key)) - 1) / size).cast("int") + 1)

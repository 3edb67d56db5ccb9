"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

An Index holds which documents have which line keys (refs), how many documents have each key and which is the last of them (counts),
and for each shard of keys a cuckoo filter of those that at_least documents have. Documents come and go by insert() and remove():
counts change for their keys alone, and keys that pass the threshold enter the filter or leave it. A line is looked up in its
shard's filter first; only what the filter does not rule out is joined with the exact counts, which decide.

A filter meets its keys in one stream a shard, sorted so that the filter comes first: a task holds one filter at a time. Keys are
looked up once, however many documents have them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WHITE, batches, cut, lookup_unique
from tessera.llm.cuckoo import SLOTS, Cuckoo

SHORTEST, AT_LEAST = 20, 3
#: Keys of a shard on average, when the index is built.
SHARD_KEYS = 1 << 15

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BARE = WHITE.encode()


@dataclass(frozen=True)
class Index:
    """refs: key, nameless, h; counts: key, n, named, top; filters: shard, filter. All but the filters' sizes follow from refs."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    buckets: int
    at_least: int


def _holder() -> list[Column]:
    """What makes rows one document: the id, or the text where the id is null."""
    return [F.col("doc_id").isNull().alias("nameless"), F.coalesce("doc_id", F.xxhash64("text")).alias("h")]


def references(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """key, nameless, h: which documents have which line keys, each once. A key is a digest of 128 bits."""
    bare = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WHITE)))
    long = F.filter(bare, lambda x: F.char_length(x) >= shortest)
    lines = docs.select(*_holder(), F.explode(F.array_distinct(long)).alias("line"))
    digest = F.substring(F.unhex(F.sha2(F.translate("line", _UPPER, _LOWER), 256)), 1, 16)
    return lines.select(digest.alias("key"), "nameless", "h").distinct()


def _counted(refs: DataFrame) -> DataFrame:
    last = F.max(F.struct((~F.col("nameless")).alias("named"), "h"))
    counts = refs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), last.alias("last"))
    return counts.select("key", "n", F.col("last.named").alias("named"), F.col("last.h").alias("top"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard")


_FILTER, _GONE, _KEY = 0, 1, 2


def _met(index: Index, keys: DataFrame, step: Column) -> DataFrame:
    """Rows of keys behind the filter of their shard, in one stream a shard."""
    rows = keys.select(_shard(index.shards), step.alias("step"), "key", F.lit(None).cast("binary").alias("filter"))
    filters = index.filters.select("shard", F.lit(_FILTER).alias("step"), F.lit(None).cast("binary").alias("key"), "filter")
    return filters.unionByName(rows).repartition("shard").sortWithinPartitions("shard", "step")


def _digests(keys: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def _advanced(index: Index, changes: DataFrame) -> DataFrame:
    """The filters after changes (key, gone): keys that leave, then keys that enter."""
    buckets = index.buckets

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, Cuckoo(buckets)
        for frame in frames:
            for (shard, step), rows in frame.groupby(["shard", "step"], sort=True):
                if at is not None and shard != at:
                    yield pd.DataFrame({"shard": [at], "filter": [held.raw()]})
                    held = Cuckoo(buckets)
                at = shard
                if step == _FILTER:
                    held = Cuckoo(buckets, rows["filter"].iloc[0])
                elif step == _GONE:
                    held.remove(_digests(rows["key"]))
                else:
                    held.add(_digests(rows["key"]))
        if at is not None:
            yield pd.DataFrame({"shard": [at], "filter": [held.raw()]})

    step = F.when(F.col("gone"), _GONE).otherwise(_KEY)
    return cut(_met(index, changes, step).mapInPandas(run, "shard int, filter binary"))


def not_ruled_out(index: Index, keys: DataFrame) -> DataFrame:
    """The keys (each once) that the filters do not rule out."""
    buckets = index.buckets

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, Cuckoo(buckets)
        for frame in frames:
            for (shard, step), rows in frame.groupby(["shard", "step"], sort=True):
                if shard != at:
                    at, held = shard, Cuckoo(buckets)
                if step == _FILTER:
                    held = Cuckoo(buckets, rows["filter"].iloc[0])
                else:
                    yield rows.loc[held.has(_digests(rows["key"])), ["key"]]

    return _met(index, keys, F.lit(_KEY)).mapInPandas(run, "key binary")


def build(docs: DataFrame, at_least: int = AT_LEAST, shortest: int = SHORTEST) -> Index:
    """An index of docs. Its shards and the size of their filters follow from the numbers of keys; a filter that fills up later grows."""
    spark = docs.sparkSession
    refs = cut(references(docs, shortest))
    counts = cut(_counted(refs))
    seen = counts.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") >= at_least).alias("repeated")).first()
    shards = max(1, seen["all"] // SHARD_KEYS)
    buckets = 1 << max(4, (seen["repeated"] * 2 // (shards * SLOTS)).bit_length())
    index = Index(refs, counts, spark.createDataFrame([], "shard int, filter binary"), shards, buckets, at_least)
    changes = counts.where(F.col("n") >= at_least).select("key", F.lit(False).alias("gone"))
    return Index(refs, counts, _advanced(index, changes), shards, buckets, at_least)


def _changed(index: Index, refs: DataFrame, counts: DataFrame, fresh: DataFrame, touched: DataFrame) -> Index:
    """The index with counts fresh for the keys touched; keys whose count passes the threshold enter a filter or leave it."""
    before = counts.join(touched, "key", "left_semi").select("key", F.col("n").alias("before"))
    both = touched.join(before, "key", "left").join(fresh.select("key", "n"), "key", "left").na.fill(0, ["n", "before"])
    was, now = F.col("before") >= index.at_least, F.col("n") >= index.at_least
    changes = both.where(was != now).select("key", was.alias("gone"))
    after = cut(counts.join(touched, "key", "left_anti").unionByName(fresh))
    return Index(refs, after, _advanced(index, changes), index.shards, index.buckets, index.at_least)


def insert(index: Index, docs: DataFrame, shortest: int = SHORTEST) -> Index:
    """The index with docs too; what it knows of them already counts once. Tables of the old index stay as they are."""
    new = cut(references(docs, shortest).join(index.refs, ["key", "nameless", "h"], "left_anti"))
    touched = cut(new.select("key").distinct())
    refs = cut(index.refs.unionByName(new))
    fresh = cut(_counted(refs.join(touched, "key", "left_semi")))
    return _changed(index, refs, index.counts, fresh, touched)


def remove(index: Index, docs: DataFrame) -> Index:
    """The index without docs, known by their ids (by their texts where an id is null); those not in it change nothing."""
    out = docs.select(*_holder()).distinct()
    touched = cut(index.refs.join(out, ["nameless", "h"], "left_semi").select("key").distinct())
    refs = cut(index.refs.join(out, ["nameless", "h"], "left_anti").select("key", "nameless", "h"))
    fresh = cut(_counted(refs.join(touched, "key", "left_semi")))
    return _changed(index, refs, index.counts, fresh, touched)


def deduplicated(index: Index, docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_lines, n_dropped, text of docs without the lines whose key at_least documents of the index have, this not the last.

    The last document is the largest id. Rows of one id are one document, rows without an id are documents by their texts and come
    before all ids. A null text is one empty line; its result is an empty text. Repeated rows come out alike. Texts of any length go through
    whole, as does a line that all documents share. Other columns play no part; an empty table gives an empty result.
    """
    refs = cut(references(docs, shortest))
    keys = cut(refs.groupBy("key").agg(F.count(F.lit(1)).alias("rows")))
    repeated = index.counts.where(F.col("n") >= index.at_least).join(not_ruled_out(index, keys.select("key")), "key")
    repeated = cut(keys.join(repeated.select("key", "named", "top"), "key"))
    own_last = F.col("named") & ~F.col("nameless") & (F.col("h") == F.col("top"))
    own_last = own_last | (~F.col("named") & F.col("nameless") & (F.col("h") == F.col("top")))
    drops = lookup_unique(refs, repeated, "key", "rows").where(~own_last)
    drops = drops.groupBy("nameless", "h").agg(F.collect_set("key").alias("drops"))  # no more than the document has lines

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches(frames):
            out = []
            for doc, text, found in zip(rows["doc_id"], rows["text"], rows["drops"], strict=True):
                lines = (text or "").split("\n")
                kept = lines
                if found is not None:
                    gone = set(found)
                    kept = [x for x in lines if hashlib.sha256(x.encode().strip(_BARE).lower()).digest()[:16] not in gone]
                out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
            yield pd.DataFrame(out, columns=["doc_id", "n_lines", "n_dropped", "text"])

    rows = docs.select(*_holder(), F.col("doc_id").cast("string").alias("doc_id"), "text").join(drops, ["nameless", "h"], "left")
    kept = rows.select("doc_id", "text", "drops").mapInPandas(run, "doc_id string, n_lines long, n_dropped long, text string")
    return kept.withColumn("doc_id", F.col("doc_id").cast("long"))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs, by an index of docs; cases as in deduplicated()."""
    kept = deduplicated(build(docs), docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
l AS (SELECT doc_id, unnest(w) AS line, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.top AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

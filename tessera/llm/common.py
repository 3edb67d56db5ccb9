"""What several operators share: durable cuts of the lineage, key-skew-safe lookups and fast word hashes."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset: a new folder if Spark runs in this process alone, as in tests, else one in the warehouse, which is shared too.
    """
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return _own_dir()
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tessera"


@cache
def _own_dir() -> str:
    made = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    atexit.register(shutil.rmtree, made, True)
    return made


#: Tables that cut() wrote outside of own_cuts() and that are still there, oldest first.
CUTS: list[str] = []
_OWN: ContextVar[list[str]] = ContextVar("own", default=CUTS)


@contextmanager
def own_cuts() -> Iterator[list[str]]:
    """Within, the tables of cut() are listed by themselves: a query that runs beside in the same driver neither sees nor loses any."""
    token = _OWN.set([])
    try:
        yield _OWN.get()
    finally:
        _OWN.reset(token)


def drop_cuts(spark: SparkSession, but: DataFrame | None = None) -> None:
    """Delete the tables of cut(), except that of `but`; for callers that have read or written the results."""
    keep = {name.rpartition("/")[0].rpartition("/")[2] for name in but.inputFiles()} if but is not None else set()
    for path in [p for p in _OWN.get() if p.rpartition("/")[2] not in keep]:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    if path in _OWN.get():
        _OWN.get().remove(path)


def cut(df: DataFrame, less: int = 1) -> DataFrame:
    """Write df as a table in the shared folder and read it back: later steps reread it, whichever executors are lost.

    less: for tables much smaller than what they come from; the part files are fewer by this factor than the shuffle's partitions.
    """
    spark = df.sparkSession
    if less > 1:
        df = df.coalesce(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // less))
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _OWN.get().append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that cut() made and that nothing will read again."""
    names = {name.rpartition("/")[0].rpartition("/")[2] for name in df.inputFiles()}
    for path in [p for p in _OWN.get() if p.rpartition("/")[2] in names]:
        _delete(df.sparkSession, path)


def words(text: Column) -> Column:
    """Array of the words of a text, none for null. Give it a column of its own before using it more than once."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WHITE_CLASS + "+"))


def lookup_unique(rows: DataFrame, unique: DataFrame, key: str, count: str, hot_share: int = 1000, keep: bool = False) -> DataFrame:
    """Inner join of rows with a table that has one row a key and, in the column count, how many of the rows carry it; keep: with that.

    Keys with over 1/hot_share of all rows are fewer than hot_share by arithmetic; they are broadcast, so that their rows are not
    shuffled. The other keys have few rows each and meet in a shuffle join. unique is read several times: give it a table.
    """
    every = unique.agg(F.sum(count)).first()[0] or 0
    hot = [r[0] for r in unique.where(F.col(count) > every / hot_share).select(key).collect()]
    unique = unique if keep else unique.drop(count)
    if not hot:
        return rows.join(unique, key)
    is_hot = F.col(key).isin(hot)
    return rows.where(is_hot).join(F.broadcast(unique.where(is_hot)), key).unionByName(rows.where(~is_hot).join(unique.where(~is_hot), key))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20240131).integers(1, 2**64, 256, dtype=np.uint64)
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as many as were asked for so far."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15) -> None:
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n >= len(self.up):
            n = max(n + 1, 2 * len(self.up))
            for name, by in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, by, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


def prefix_sums(raw: np.ndarray, powers: Powers) -> np.ndarray:
    """S with S[i] the sum of value(raw[j]) * base**j over j < i: one pass gives the hash of any stretch of raw."""
    powers.reach(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[raw] * powers.up[: len(raw)], out=out[1:], dtype=np.uint64)
    return out


def word_hashes(texts: list[str | None], powers: Powers, places: bool = False) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all the words of the texts, in order, A-Z taken as a-z, and the number of words of each text.

    With places also each word's start and end in the joined texts, and their prefix sums.
    """
    joined = "\n".join("" if t is None else t for t in texts).encode("utf-8", "surrogatepass")
    raw = _LOWER[np.frombuffer(joined, np.uint8)]
    lengths = np.fromiter((0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in texts), np.int64, len(texts))
    ends_of_texts = np.cumsum(lengths + 1) - 1
    inside = np.concatenate(([False], ~_IS_WHITE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = prefix_sums(raw, powers)
    hashes = stretch_hashes(sums, starts, ends, powers)
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends_of_texts, "right"))))
    return (hashes, counts, starts, ends, sums) if places else (hashes, counts)


def stretch_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """Hashes of the stretches raw[start:end], alike wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * powers.down[starts] ^ ((ends - starts).astype(np.uint64) * _ODD))


def by_document(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """mapInPandas over rows with a doc_id, which run passes on as it gets it; schema: its other columns.

    On its way the id is text, as pandas would take a column of whole numbers with nulls for floating point.
    """
    out = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, f"doc_id string, {schema}")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def batches(frames: Iterator, most_chars: int = 8_000_000) -> Iterator:
    """Parts of pandas frames with about most_chars characters of text, so that memory stays bounded."""
    for frame in frames:
        if not len(frame):
            continue
        size = frame["text"].str.len().fillna(0).to_numpy(np.int64).cumsum()
        part = (size - 1).clip(0) // most_chars
        for _, rows in frame.groupby(part, sort=True):
            yield rows

"""Collocations by pivot partitioning: every n-gram is counted where its rarest word is, and nowhere else.

A first pass counts words and their neighbouring pairs and triples in tables of fixed size, by hash. A cell bounds the count of all
that falls into it, so what has a low cell is in no frequent phrase, and text is cut there. The second pass rewrites the rest: around
each occurrence of a word it keeps the words to the left that are more frequent, and those to the right that are not rarer, up to four.
Such a fragment goes to its word, the pivot; there the n-grams over the pivot's place are counted. Rarity is the word's cell, then its
hash, which is a total order; of equal words the leftmost is the pivot. Pivots with many occurrences are split over parts by the
fragment, whose sums are added up once more. With far more text than cells the tables cut little, and fragments grow to nine words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Powers, batches, cut, mix, prefix_sums, stretch_hashes

LONGEST, AT_LEAST, TOP = 5, 100, 2000
#: Cells for words, and as many for pairs as for triples, in chunks: 138 MB in a task that counts. What is broadcast of them has 4 MB each.
WORD_CELLS, CELLS, CHUNK = 1 << 20, 1 << 24, 1 << 16
#: Occurrences of a pivot in one part, by its cell.
PART = 1 << 15
#: Words that a task counts before it passes their counts on, and characters that it reads at once.
COUNTED, AT_ONCE = 400_000, 400_000

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _BREAKS + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * len(_BREAKS) + b" ")
_SPACES = re.compile(rb" {2,}")


class Words(NamedTuple):
    """All words of some texts of one language: the bytes, with one space between words of a piece, and each word's place and hash."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    sums: np.ndarray
    hashes: np.ndarray
    joined: np.ndarray  # whether a word and the next one are of one piece

    def cells(self) -> np.ndarray:
        return (self.hashes & np.uint64(WORD_CELLS - 1)).astype(np.int64)

    def pair_cells(self) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each word with the next one, and of each with the next two."""
        with np.errstate(over="ignore"):
            pair = mix(self.hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[1:])
            triple = mix(pair[:-1] * np.uint64(0x9E3779B97F4A7C15) + self.hashes[2:])
        cell = lambda x: (x & np.uint64(CELLS - 1)).astype(np.int64)
        return cell(pair), CELLS + cell(triple)


def read(texts: list[str | None], lang: str, powers: Powers) -> Words:
    raw = _SPACES.sub(b" ", "\n".join(t or "" for t in texts).encode("utf-8", "replace").translate(_TABLE))
    at = np.frombuffer(raw, np.uint8)
    inside = np.concatenate(([False], (at != 32) & (at != 10), [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = prefix_sums(at, powers)
    hashes = mix(stretch_hashes(sums, starts, ends, powers) ^ np.uint64(zlib.crc32(lang.encode())))
    breaks = np.concatenate(([0], np.cumsum(at == 10)))
    return Words(raw, starts, ends, sums, hashes, breaks[starts[1:]] == breaks[ends[:-1]])


def _by_lang(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, list[str | None]]]:
    for rows in batches(frames, AT_ONCE):
        for lang, part in rows.groupby("lang", sort=False):
            yield lang, part["text"].tolist()


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def packed(cells: np.ndarray) -> bytes:
    """A chunk of counts, most of them small: a byte each, and those of 255 and more by place."""
    large = np.flatnonzero(cells >= 255)
    return zlib.compress(np.minimum(cells, 255).astype(np.uint8).tobytes() + large.astype(np.uint32).tobytes() + cells[large].tobytes(), 1)


def unpacked(raw: bytes) -> np.ndarray:
    raw = zlib.decompress(raw)
    out = np.frombuffer(raw, np.uint8, CHUNK).astype(np.int64)
    large, counts = np.frombuffer(raw, np.uint32, offset=CHUNK).reshape(2, -1)
    out[large] = counts
    return out


def first_pass(docs: DataFrame) -> DataFrame:
    """chunk, cells: each task's part of the tables by hash, packed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        cells = np.zeros(WORD_CELLS + 2 * CELLS, np.uint32)
        for lang, texts in _by_lang(frames):
            w = read(texts, lang, powers)
            np.add.at(cells, w.cells(), 1)
            if len(w.starts) > 1:
                pairs, triples = w.pair_cells()
                np.add.at(cells, WORD_CELLS + pairs[w.joined], 1)
                np.add.at(cells, WORD_CELLS + triples[w.joined[:-1] & w.joined[1:]], 1)
        for i in range(0, len(cells), CHUNK):
            if cells[i : i + CHUNK].any():
                yield pd.DataFrame({"chunk": [i // CHUNK], "cells": [packed(cells[i : i + CHUNK])]})

    return _texts(docs).mapInPandas(run, "chunk int, cells binary")


def tables(chunks: DataFrame, at_least: int) -> tuple[np.ndarray, np.ndarray]:
    """The cells of words, up to 2**32 - 1, and whether each cell of pairs or triples reaches at_least. Of fixed size, whatever the input."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, np.zeros(CHUNK, np.int64)
        said = lambda: pd.DataFrame({"chunk": [at], "cells": [(total.clip(max=2**32 - 1).astype(np.uint32) if at < WORD_CELLS // CHUNK else np.packbits(total >= at_least)).tobytes()]})
        for frame in frames:
            for chunk, raw in zip(frame["chunk"], frame["cells"], strict=True):
                if chunk != at:
                    if at is not None:
                        yield said()
                    at, total = chunk, np.zeros(CHUNK, np.int64)
                total += unpacked(raw)
        if at is not None:
            yield said()

    words, runs = np.zeros(WORD_CELLS, np.uint32), np.zeros(2 * CELLS // 8, np.uint8)
    for chunk, raw in chunks.repartition("chunk").sortWithinPartitions("chunk").mapInPandas(run, "chunk int, cells binary").collect():
        if chunk < WORD_CELLS // CHUNK:
            words[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(raw, np.uint32)
        else:
            at = (chunk - WORD_CELLS // CHUNK) * CHUNK // 8
            runs[at : at + CHUNK // 8] = np.frombuffer(raw, np.uint8)
    return words, runs


def extents(rarity: np.ndarray, pairs: np.ndarray, triples: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """How many words to the left of each are more frequent, and to the right not rarer, up to reach, as far as pairs and triples of neighbours go on."""
    n = len(rarity)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    goes_left, goes_right = np.ones(n, bool), np.ones(n, bool)
    for d in range(1, min(reach, n - 1) + 1):
        run = pairs if d == 1 else triples  # the run that the word brings in
        goes_left[:d] = False
        goes_left[d:] &= run[: n - d] & (rarity[: n - d] > rarity[d:])
        goes_right[n - d :] = False
        goes_right[: n - d] &= run[max(d - 2, 0) :][: n - d] & (rarity[d:] >= rarity[: n - d])
        left += goes_left
        right += goes_right
    return left, right


def fragments(docs: DataFrame, known: Broadcast, at_least: int, longest: int) -> DataFrame:
    """lang, part (0: its pivot has no others), place (of the pivot), fragment, n: the rewritten text, equal fragments of a batch once.

    The pivot is read from the fragment, so that what is shuffled has it once. Words that may be frequent are fragments by themselves, and the empty fragment has the number of all words of its lang.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, counted = Powers(), Counter()
        words, runs = known.value
        flag = lambda cells: ((runs[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).astype(bool)
        said = lambda: pd.DataFrame({"lang": [k[0] for k in counted], "part": 0, "place": 0, "fragment": [k[1] for k in counted], "n": list(counted.values())})
        for lang, texts in _by_lang(frames):
            w = read(texts, lang, powers)
            text = lambda a, b, raw=w.raw: [raw[i:j].decode("utf-8", "replace") for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            counted[lang, ""] += len(w.starts)
            often = words[w.cells()]
            frequent = often >= at_least
            _, first, n = np.unique(w.hashes[frequent], return_index=True, return_counts=True)
            first = np.flatnonzero(frequent)[first]
            for word, k in zip(text(w.starts[first], w.ends[first]), n.tolist(), strict=True):
                counted[lang, word] += k
            if len(counted) > COUNTED:
                yield said()
                counted.clear()
            if len(w.starts) < 2:
                continue
            pairs, triples = w.pair_cells()
            pairs = w.joined & frequent[:-1] & frequent[1:] & flag(pairs)
            triples = pairs[:-1] & pairs[1:] & flag(triples)
            rarity = (often.astype(np.uint64) << np.uint64(32)) | (w.hashes >> np.uint64(32))
            left, right = extents(rarity, pairs, triples, longest - 1)
            at = np.flatnonzero(left + right)
            if not len(at):
                continue
            begin, end = w.starts[at - left[at]], w.ends[at + right[at]]
            with np.errstate(over="ignore"):
                same = stretch_hashes(w.sums, begin, end, powers) + left[at].astype(np.uint64)
            same, first, n = np.unique(same, return_index=True, return_counts=True)
            at, begin, end = at[first], begin[first], end[first]
            parts = often[at].astype(np.int64) // PART + 1
            part = np.where(parts > 1, (same % parts.astype(np.uint64)).astype(np.int64) + 1, 0)
            yield pd.DataFrame({"lang": lang, "part": part, "place": left[at], "fragment": text(begin, end), "n": n})
        if counted:
            yield said()

    return _texts(docs).mapInPandas(run, "lang string, part long, place int, fragment string, n long")


def _owned(longest: int) -> Column:
    """The n-grams of two words or more over the pivot's place; of a fragment of one word, itself."""
    return F.expr(f"""CASE WHEN size(w) = 1 THEN w ELSE flatten(transform(sequence(0, place), s -> CASE WHEN greatest(place, s + 1) <= least(size(w) - 1, s + {longest - 1})
        THEN transform(sequence(greatest(place, s + 1), least(size(w) - 1, s + {longest - 1})), e -> array_join(slice(w, s + 1, e - s + 1), ' '))
        ELSE array() END)) END""")


def frequent_phrases(docs: DataFrame, at_least: int = AT_LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Words and phrases (lang, phrase, f) that occur at_least times, and the number of words n of each lang that has so many."""
    spark: SparkSession = docs.sparkSession
    known = spark.sparkContext.broadcast(tables(first_pass(docs), at_least))
    words = F.split("fragment", " ")
    pivot = F.get(words, F.col("place"))
    routed = fragments(docs, known, at_least, longest).repartition("lang", pivot, "part")
    grams = routed.withColumns({"pivot": pivot, "w": words}).select("lang", "pivot", "part", "n", F.explode(_owned(longest)).alias("phrase"))
    # the pivot's own partition has all of a part's fragments: no shuffle here
    mined = grams.groupBy("lang", "pivot", "part", "phrase").agg(F.sum("n").alias("f")).where((F.col("part") > 0) | (F.col("f") >= at_least))
    frequent = cut(mined.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= at_least))
    return frequent.where("phrase <> ''"), frequent.where("phrase = ''").select("lang", F.col("f").alias("n"))


def _part(a: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("w", a, n), " ")


def collocations(docs: DataFrame, at_least: int = AT_LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each lang (null: und), scored by their weakest cut.

    Null and empty texts have no words; an empty table gives no rows. Repeated rows count each time. Texts go through whole, and a
    word, phrase or lang of any frequency is split over tasks. Ties in rank go to the higher count, then the smaller phrase. Other
    columns, and ids, play no part.
    """
    known, totals = frequent_phrases(docs, at_least, longest)
    found = known.withColumn("w", F.split("phrase", " ")).withColumn("len", F.size("w")).where("len > 1")
    places = F.transform(F.sequence(F.lit(1), F.col("len") - 1), lambda k: F.struct(k.alias("k"), _part(F.lit(1), k).alias("first"), _part(k + 1, F.col("len") - k).alias("rest")))
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), F.inline(places))
    l, r = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(l, ["lang", "first"]).join(r, ["lang", "rest"]).join(totals, "lang")
    exact = F.expr("CAST(1000 * CAST(a AS DECIMAL(15, 0)) * CAST(n AS DECIMAL(15, 0)) AS DECIMAL(38, 0)) DIV (CAST(l AS DECIMAL(15, 0)) * CAST(r AS DECIMAL(15, 0)))")
    weakest = F.min(F.struct(exact.alias("score"), "k", "l", "r", "n")).alias("c")
    scored = cuts.groupBy("lang", "phrase", "a").agg(weakest).select("lang", "phrase", "a", "c.l", "c.r", "c.n", "c.score")
    # what lies in any longer candidate of equal count lies in one that is a word longer, as counts fall with length
    longer = found.where("len > 2").select("lang", "f", F.explode(F.array(_part(F.lit(1), F.col("len") - 1), _part(F.lit(2), F.col("len") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where("most IS NULL OR most < a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = kept.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(docs: DataFrame) -> DataFrame:
    return collocations(docs)


SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase FROM w, range(1, 6) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, k AS len, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
t AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE len > 1),
x AS (SELECT c.*, k, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM c, range(1, 5) AS t(k) WHERE k < len),
s AS (SELECT x.lang, x.phrase, x.a, x.k, l.f AS l, r.f AS r, t.n, CAST(1000::HUGEINT * x.a * t.n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM x JOIN f l ON l.lang = x.lang AND l.phrase = x.first JOIN f r ON r.lang = x.lang AND r.phrase = x.rest JOIN t ON t.lang = x.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN c ON b.lang = c.lang AND c.a >= b.a AND len(string_split(b.phrase, ' ')) < c.len AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank FROM b LEFT JOIN d ON b.lang = d.lang AND b.phrase = d.phrase WHERE d.phrase IS NULL)
SELECT lang, rank, phrase, a, l, r, n, score FROM q WHERE rank <= 2000
"""

"""Removal of long strings that are repeated anywhere in the corpus, byte by byte.

A string of LENGTH bytes is repeated if it starts at two places. Suffix arrays decide which are, built within groups small enough for
one task, and the groups are made so that equal strings always share one:

1. Each string has a minimizer, the leftmost of its CORE-byte parts with the least hash. Equal strings have equal minimizers at equal
   places. A sparse choice (SPARSE bytes) finds the strings whose minimizer is not the only one of its kind; most texts end here.
2. For those left a dense choice (CORE bytes) is taken. All strings with one minimizer are cut out as a context: bytes left of the
   core, the core, bytes right of it. Within a group of equal cores the core is one symbol, so contexts are short.
3. Contexts that occur twice are repeated as a whole. The others meet in their group's suffix array, where equal strings stand side
   by side. A group of more than MOST_CONTEXTS different contexts is split by the bytes next to its core: strings that reach about
   equally far left share those bytes, which join the core. Parts that are still large are split again; after three times a part is
   one string, so no group reaches a task whole.

Texts that occur twice as a whole need none of this.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Powers, batches, by_document, cut, drop_cut, lookup_unique, prefix_sums, stretch_hashes
from tessera.llm.suffixes import suffix_array

LENGTH, SPARSE, CORE = 400, 100, 350
#: Contexts that one suffix array is built over at most; larger groups are split into PARTS parts.
MOST_CONTEXTS, PARTS = 500, 4
#: Symbols that a suffix array is built over at least, and bytes of a text that are looked at at once.
GATHERED, STEP = 50_000, 256 * 1024
#: Contexts, or bytes of texts, that a frame holds.
FRAME, FRAME_BYTES = 5_000, 4_000_000


def least_in_windows(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of keys[i : i + width] for each i that has so many."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def minimizers(raw: np.ndarray, ends: np.ndarray, core: int, powers: Powers) -> tuple[np.ndarray, ...]:
    """For texts that lie end to end in raw: text, minimizer's place and hash, first and last start of the strings that have it.

    Starts lie in one text each, with LENGTH bytes in it from them on.
    """
    parts = []
    for a in range(0, len(raw), STEP):
        piece = raw[a : a + STEP + LENGTH - 1]
        if len(piece) < LENGTH:
            break
        at = np.arange(len(piece) - core + 1)
        hashes = stretch_hashes(prefix_sums(piece, powers), at, at + core, powers)
        mask = np.uint64(2**24 - 1)
        least = least_in_windows(hashes & ~mask | at.astype(np.uint64), LENGTH - core + 1)
        starts = np.arange(len(least))
        text = np.searchsorted(ends, starts + a, "right")
        keep = starts + a + LENGTH <= ends[np.minimum(text, len(ends) - 1)]
        starts, text, chosen = starts[keep], text[keep], (least[keep] & mask).astype(np.int64)
        if not len(starts):
            continue
        new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]) | (np.diff(starts) != 1))))
        last = np.append(new[1:] - 1, len(starts) - 1)
        parts.append((text[new], chosen[new] + a, hashes[chosen[new]], starts[new] + a, starts[last] + a))
    if not parts:
        return tuple(np.zeros(0, np.uint64 if i == 2 else np.int64) for i in range(5))
    text, chosen, h, first, last = (np.concatenate(x) for x in zip(*parts, strict=True))
    # a minimizer whose strings lie in two pieces is one
    new = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1]) | (first[1:] != last[:-1] + 1))))
    return text[new], chosen[new], h[new], first[new], last[np.append(new[1:] - 1, len(last) - 1)]


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(encoded), np.uint8), np.cumsum([len(x) for x in encoded])


def sparse_minimizers(rows: DataFrame) -> DataFrame:
    """doc_id, key, h, place (alike for equal places of equal texts), first, last (starts, in bytes of the text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for part in batches(frames, 2_000_000):
            raw, ends = _joined(part["text"].tolist())
            text, at, h, first, last = minimizers(raw, ends, SPARSE, powers)
            begin = np.concatenate(([0], ends[:-1])).astype(np.int64)[text] if len(text) else np.zeros(0, np.int64)
            digest = part["digest"].to_numpy(np.int64)[text].view(np.uint64)
            with np.errstate(over="ignore"):
                place = (digest ^ ((at - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[text], "key": part["key"].to_numpy()[text], "h": h.view(np.int64), "place": place, "first": (first - begin).astype(np.int32), "last": (last - begin).astype(np.int32)})

    return by_document(rows, run, "key long, h long, place long, first int, last int")


def contexts(suspects: DataFrame) -> DataFrame:
    """doc_id, key, first, n (strings of the context), core, left, right, ctx: contexts of the dense minimizers within the ranges of suspects."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        out: list[tuple] = []
        frame = lambda: pd.DataFrame(out, columns=["doc_id", "key", "first", "n", "core", "left", "right", "ctx"])
        for part in batches(frames, 1_000_000):
            for doc, key, body, ranges in zip(part["doc_id"], part["key"], part["text"], part["ranges"], strict=True):
                encoded = body.encode("utf-8", "surrogatepass")
                spans = sorted((r["first"], r["last"]) for r in ranges)
                joined: list[list[int]] = []
                for a, b in spans:
                    if joined and a <= joined[-1][1] + 1:
                        joined[-1][1] = max(b, joined[-1][1])
                    else:
                        joined.append([a, b])
                for a, b in joined:
                    stretch = encoded[a : b + LENGTH]
                    _, at, _, first, last = minimizers(np.frombuffer(stretch, np.uint8), np.array([len(stretch)]), CORE, powers)
                    for p, f, g in zip(at.tolist(), first.tolist(), last.tolist(), strict=True):
                        core = hashlib.blake2b(stretch[p : p + CORE], digest_size=16).digest()
                        left, right = stretch[f:p], stretch[p + CORE : g + LENGTH]
                        out.append((doc, key, a + f, g - f + 1, core, left, right, hashlib.blake2b(core + len(left).to_bytes(4, "big") + left + right, digest_size=16).digest()))
                        if len(out) >= FRAME:
                            yield frame()
                            out.clear()
        if out:
            yield frame()

    return by_document(suspects, run, "key long, first int, n int, core binary, left binary, right binary, ctx binary")


def runs(numbers: list[int]) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers; numbers in order."""
    if not numbers:
        return []
    at = np.asarray(numbers)
    new = np.flatnonzero(np.diff(at) != 1)
    return list(zip(at[np.concatenate(([0], new + 1))].tolist(), at[np.append(new, len(at) - 1)].tolist(), strict=True))


def repeated_in(groups: list[tuple[int, list[tuple[bytes, bytes, int]]]]) -> list[list[list[int]]]:
    """For each context (left, right, number of strings) of each group of equal cores: starts of strings that another one there has too.

    A group comes with how many bytes its strings have beside the core.
    """
    text: list[int] = []
    whose: dict[int, tuple[int, int, int]] = {}
    for g, (_, group) in enumerate(groups):
        for c, (left, right, n) in enumerate(group):
            whose |= {len(text) + o: (g, c, o) for o in range(n)}
            text += [b + 2 for b in left]
            text.append(258 + g)
            text += [b + 2 for b in right]
            text.append(1)
    found: list[list[list[int]]] = [[[] for _ in group] for _, group in groups]
    order = np.array([i for i in suffix_array(text) if i in whose], np.int64)
    width = np.array([groups[whose[i][0]][0] + 1 for i in order.tolist()], np.int64)
    reach = np.arange(max(f for f, _ in groups) + 1)
    flat = np.array(text + [0] * len(reach), np.int32)
    # strings of different groups differ at a core, which stands within the width of each
    rows = flat[order[:, None] + reach]
    equal = ((rows[1:] == rows[:-1]) | (reach >= np.minimum(width[1:], width[:-1])[:, None])).all(1)
    twice = np.concatenate(([False], equal)) | np.concatenate((equal, [False]))
    for at in order[twice].tolist():
        g, c, o = whose[at]
        found[g][c].append(o)
    return found


_RUNS = "array<struct<a:int,b:int>>"


def _gathered(rows: DataFrame) -> DataFrame:
    """ctx, runs (of repeated strings) for the contexts of rows (core, ctx, left, right, n, beside), whose groups are small."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solved(groups: list[tuple[int, list[tuple]]]) -> pd.DataFrame:
            found = repeated_in([(beside, [x[1:] for x in group]) for beside, group in groups])
            out = [(x[0], [{"a": a, "b": b} for a, b in runs(sorted(starts))]) for (_, group), hits in zip(groups, found, strict=True) for x, starts in zip(group, hits, strict=True) if starts]
            return pd.DataFrame(out, columns=["ctx", "runs"])

        groups, held, core = [], 0, None
        for frame in frames:
            for c, ctx, left, right, n, beside in zip(frame["core"], frame["ctx"], frame["left"], frame["right"], frame["n"], frame["beside"], strict=True):
                if c != core:
                    if held >= GATHERED:
                        yield solved(groups)
                        groups, held = [], 0
                    groups.append((beside, []))
                    core = c
                groups[-1][1].append((ctx, left, right, n))
                held += len(left) + len(right) + 2
        if groups:
            yield solved(groups)

    sorted_rows = rows.select("core", "ctx", "left", "right", "n", "beside").repartition("core").sortWithinPartitions("core", "ctx")
    return sorted_rows.mapInPandas(run, f"ctx binary, runs {_RUNS}")


def split_contexts(rows: DataFrame) -> DataFrame:
    """ctx, shift, and core, left, right, n, beside of the parts of contexts (core, ctx, left, right, n, beside).

    A string with u bytes left of the core has beside - u right of it. Those with u from lo to hi have the lo bytes next to the core on
    its left in common with their context, and beside - hi on its right; these join the core. A string's first start in the part is
    shift starts after the context's.
    """
    step = F.floor(F.col("beside") / PARTS + 1).cast("int")
    lo = F.explode(F.sequence(F.lit(0), F.col("beside"), F.col("_step")))
    rows = rows.withColumn("_step", step).withColumn("_lo", lo)
    length, hi = F.length("left"), F.least(F.col("_lo") + F.col("_step") - 1, F.col("beside"))
    rows = rows.withColumns({"_hi": hi, "_length": length})
    rows = rows.withColumns({"_top": F.least("_length", "_hi"), "_low": F.greatest(F.col("_length") - F.col("n") + 1, "_lo")}).where("_top >= _low")
    core = F.concat(
        "core", F.concat_ws(":", "_lo", "beside").cast("binary"),
        F.expr("substring(left, _length - _lo + 1, _lo)"), F.expr("substring(right, 1, beside - _hi)"),
    )
    return rows.select(
        "ctx", (F.col("_length") - F.col("_top")).alias("shift"), F.unhex(F.md5(core)).alias("core"),
        F.expr("substring(left, _length - _top + 1, _top - _lo)").alias("left"), F.expr("substring(right, beside - _hi + 1, _hi - _low)").alias("right"),
        (F.col("_top") - F.col("_low") + 1).alias("n"), (F.col("_hi") - F.col("_lo")).alias("beside"),
    )


def decided(different: DataFrame) -> DataFrame:
    """ctx, runs, t (how many rows the context may have in the caller's tables): first and last of the repeated strings of contexts.

    different: core, ctx, left, right, n, beside, times (places that have the context), rows; one row a context.
    """
    groups = cut(different.groupBy("core").agg(F.count(F.lit(1)).alias("contexts"), F.min("times").alias("least")).where("contexts > 1 AND least = 1").select("core", "contexts"))
    whole = different.where("times > 1").select("ctx", F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b"))).alias("runs"), F.col("rows").alias("t"))
    most = groups.agg(F.max("contexts")).first()[0]
    if most is None:
        return whole
    open_ = cut(lookup_unique(different, groups, "core", "contexts", keep=True))
    solved = _gathered(open_.where(F.col("contexts") <= MOST_CONTEXTS))
    if most > MOST_CONTEXTS:
        parts = split_contexts(open_.where(F.col("contexts") > MOST_CONTEXTS).select("ctx", "core", "left", "right", "n", "beside", "times"))
        parts = cut(parts.withColumn("part", F.unhex(F.md5(F.concat("core", F.length("left").cast("string").cast("binary"), "left", "right")))))
        times = open_.select("ctx", "times")
        pieces = parts.join(times, "ctx").groupBy(F.col("part").alias("ctx"), "core", "left", "right", "n", "beside").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows"))
        verdicts = cut(decided(cut(pieces)).select(F.col("ctx").alias("part"), "runs", "t"))
        hit = lookup_unique(parts.select("part", F.col("ctx"), "shift"), verdicts, "part", "t")
        shifted = hit.select("ctx", F.transform("runs", lambda r: F.struct((r["a"] + F.col("shift")).alias("a"), (r["b"] + F.col("shift")).alias("b"))).alias("runs"))
        solved = solved.unionByName(shifted.groupBy("ctx").agg(F.flatten(F.collect_list("runs")).alias("runs")))
    return whole.unionByName(solved.join(different.where("times = 1").select("ctx", F.col("rows").alias("t")), "ctx"))


def with_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), digest of the text and key of the row; (doc_id, key) stands for a text of a document."""
    text = F.coalesce("text", F.lit(""))
    named = docs.select("doc_id", text.alias("text")).withColumn("md5", F.md5(F.col("text").cast("binary")))
    digest = F.conv(F.substring("md5", 1, 16), 16, -10).cast("long")
    return named.withColumn("digest", digest).withColumn("key", F.xxhash64(F.col("md5"), F.col("doc_id")))


def removed_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts that occur twice (doc_id, key), and those with repeated strings (doc_id, key, text, runs: first and last of each run of their starts)."""
    rows = with_keys(docs)
    light = cut(rows.select("doc_id", "key", "md5", F.octet_length("text").alias("bytes")).where(F.col("bytes") >= LENGTH))
    classes = cut(light.groupBy("md5").agg(F.count(F.lit(1)).alias("copies"), F.min(F.coalesce("doc_id", F.lit(-(2**63)))).alias("first_id")).where("copies > 1"))
    copied = cut(lookup_unique(light, classes, "md5", "copies").select("doc_id", "key", F.coalesce("doc_id", F.lit(-(2**63))).alias("i"), "first_id").distinct())
    drop_cut(light)
    sparse = cut(sparse_minimizers(rows.where(F.octet_length("text") >= LENGTH).select("doc_id", "key", "digest", "text")))
    # a minimizer is of interest if it is at two places; a copy's places are those of its text
    again = sparse.groupBy("h").agg(F.min("place").alias("a"), F.max("place").alias("b"), F.count(F.lit(1)).alias("times")).where("a <> b").select("h", "times")
    hits = lookup_unique(sparse.select("doc_id", "key", "h", "first", "last"), cut(again), "h", "times")
    # of copies only the first is looked at: what others share with it, it shares with them
    others = copied.where("i <> first_id").select("doc_id", "key")
    same = lambda other: ["doc_id", "key"] if other else None
    ranges = hits.groupBy(*same(True)).agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    ranges = cut(_anti(ranges, others))
    drop_cut(sparse)
    texts = rows.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "text")
    suspects = cut(texts.join(ranges, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key"))).select("doc_id", "key", "text", "ranges").dropDuplicates(["doc_id", "key"]))
    found = cut(contexts(suspects))
    different = cut(found.groupBy("core", "ctx", "left", "right", "n").agg(F.count(F.lit(1)).alias("times")).withColumns({"rows": F.col("times"), "beside": F.lit(LENGTH - CORE)}))
    verdicts = cut(decided(different))
    hit = lookup_unique(found.select("doc_id", "key", "first", "ctx"), verdicts, "ctx", "t")
    places = hit.select("doc_id", "key", F.transform("runs", lambda r: F.struct((r["a"] + F.col("first")).alias("a"), (r["b"] + F.col("first")).alias("b"))).alias("runs"))
    per_text = places.groupBy("doc_id", "key").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    partly = suspects.select("doc_id", "key", "text").join(per_text.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "runs"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    return copied.select("doc_id", "key"), partly.select("doc_id", "key", "text", "runs")


def _anti(rows: DataFrame, others: DataFrame) -> DataFrame:
    other = others.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"))
    return rows.join(other, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("key") == F.col("_k")), "left_anti")


def stripped(partly: DataFrame) -> DataFrame:
    """doc_id, key, n_removed, n_spans, kept (bytes) of texts with the runs of starts of their repeated strings."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, FRAME_BYTES):
            out = []
            for doc, key, text, starts in zip(frame["doc_id"], frame["key"], frame["text"], frame["runs"], strict=True):
                raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                edges = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edges, [r["a"] for r in starts], 1)
                np.add.at(edges, [r["b"] + LENGTH for r in starts], -1)
                gone = np.cumsum(edges[:-1], dtype=np.int32) > 0
                spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((doc, key, int(gone.sum()), spans, raw[~gone].tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "key", "n_removed", "n_spans", "kept"])

    return by_document(partly, run, "key long, n_removed long, n_spans long, kept binary")


def query(docs: DataFrame) -> DataFrame:
    """A row a document: bytes, removed bytes and runs, and the digest of the rest.

    Null and empty texts keep their nothing; repeated rows, and rows with a null id, are texts like others, so a row that comes twice
    is removed as far as it has LENGTH bytes. Long texts are read STEP bytes at a time. Other columns play no part, whatever their
    names. An empty table gives an empty result.
    """
    copied, partly = removed_spans(docs)
    some = stripped(_anti(partly, copied)).select("doc_id", "key", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    every = copied.select("doc_id", "key", F.lit(-1).cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(b""), 256).alias("kept_sha256"))
    verdict = cut(some.unionByName(every)).select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "n_removed", "n_spans", F.col("kept_sha256").alias("kept"))
    rows = with_keys(docs).select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    joined = rows.join(verdict, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    removed: Column = F.when(F.col("n_removed") == -1, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
    return joined.select("doc_id", "n_bytes", removed.alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))

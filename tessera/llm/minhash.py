"""MinHash near-dedup by banded signatures.

A signature has POSITIONS minima of 16 bits, in BANDS bands. Two documents meet under the key of each band in which they agree. Only the
first such band counts, and only where LIKELY of all positions agree. A pair with a similarity of 0.75 is missed with a chance of 4 in a
million (2 by the bands, 2 by LIKELY), less above.

Links are confirmed on the full sets. As what is asked for are components, pairs that are connected already need no check. Under keys of
FEW documents at most, pairs that connect all of them, the likeliest first, are checked at first, and then those others that still lie
between components. Documents of keys with more are dealt into blocks; each two blocks meet with their sets and are settled there, pair by
pair, the likeliest first. Blocks are no way for keys of over MANY documents: these are compared by their rarest shingles, which misses
no pair that is similar enough: the likeliest pair of two components first, and the others only where these are not connected by then.
These pairs are listed in portions, so that labels connected by one are not listed by the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WHITE, Powers, batches, by_document, cut, drop_cut, lookup_unique, mix, word_hashes
from tessera.llm.components import components

SHINGLE, PER_CENT = 5, 75
BANDS, IN_BAND = 24, 3
POSITIONS, LIKELY = BANDS * IN_BAND, 36
#: Keys of so many documents list their pairs; those of so many at most are settled in blocks of BLOCK documents and of BLOCK_SHINGLES shingles.
FEW, MANY, BLOCK, BLOCK_SHINGLES = 32, 8000, 800, 1_000_000
#: The band of a key stands in front of so many bits of its hash.
KEY_BITS = 58
#: Rows are dealt into DEALT parts for the portions in which the pairs left are listed; portions grow by the factor PORTION.
DEALT, PORTION = 2**16, 4

_MULTIPLIERS = np.random.default_rng(4).integers(1, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64))


def shingles(texts: list[str | None], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, in order and with repeats, and how many each text has.

    A text of fewer than SHINGLE words has one, of all its words; one without words has none.
    """
    words, counts = word_hashes(texts, powers)
    n, ends = len(words), np.cumsum(counts)
    starts = ends - counts
    rolled = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(SHINGLE, n)):
            rolled[: n - i] += mix(words[i:] ^ _STEPS[i])
        whole = np.zeros(n, bool)
        for a, c in zip(starts[(counts > 0) & (counts < SHINGLE)], counts[(counts > 0) & (counts < SHINGLE)], strict=True):
            rolled[a] = mix(words[a : a + c] ^ _STEPS[:c]).sum(dtype=np.uint64) + np.uint64(c)
            whole[a] = True
    keep = np.arange(n) + SHINGLE <= np.repeat(ends, counts)
    return mix(rolled[keep | whole]), np.where(counts >= SHINGLE, counts - SHINGLE + 1, counts > 0)


def distinct_sets(texts: list[str | None], powers: Powers) -> list[np.ndarray]:
    hashes, counts = shingles(texts, powers)
    return [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of 16-bit minima a set; none may be empty."""
    if not sets:
        return np.zeros((0, POSITIONS), np.uint16)
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *[len(x) for x in sets[:-1]]])
    out = np.empty((len(sets), POSITIONS), np.uint16)
    with np.errstate(over="ignore"):
        for i, m in enumerate(_MULTIPLIERS):
            out[:, i] = mix(np.minimum.reduceat(joined * m, starts)) & np.uint64(2**16 - 1)
    return out


def stacked(sigs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(-1, POSITIONS)


def keys(sigs: np.ndarray) -> np.ndarray:
    """A row of keys a signature, one a band; those of earlier bands are smaller."""
    wide = sigs.astype(np.uint64)
    out = np.empty((len(sigs), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(BANDS):
            key = np.full(len(sigs), i + 1, np.uint64)
            for p in range(i * IN_BAND, (i + 1) * IN_BAND):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[:, p])
            out[:, i] = np.uint64(i << KEY_BITS) | key & np.uint64(2**KEY_BITS - 1)
    return out


def digest(x: np.ndarray) -> bytes:
    """Digest of a set of hashes: its size and two sums over it."""
    with np.errstate(over="ignore"):
        return np.array([len(x), mix(x).sum(dtype=np.uint64), mix(x ^ np.uint64(len(x))).sum(dtype=np.uint64)], np.uint64).tobytes()


def row_key() -> Column:
    """Alike for rows with equal id and text."""
    return F.xxhash64("doc_id", "text")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, row (its row_key), n (distinct shingles), cls (digest of the set), sig; cls and sig null for texts without words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for rows in batches(frames, 2_000_000):
            sets = distinct_sets(rows["text"].tolist(), powers)
            n = np.array([len(x) for x in sets], np.int64)
            sig = iter(signatures([x for x in sets if len(x)]))
            cls = [digest(x) if len(x) else None for x in sets]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "row": rows["row"].to_numpy(), "n": n, "cls": cls, "sig": [next(sig).tobytes() if c else None for c in cls]})

    return by_document(docs.select("doc_id", row_key().alias("row"), "text"), run, "row long, n long, cls binary, sig binary")


def keyed(reps: DataFrame) -> DataFrame:
    """key, id: all keys of each representative."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 2000):
                part = frame.iloc[i : i + 2000]
                yield pd.DataFrame({"key": keys(stacked(part["sig"])).view(np.int64).ravel(), "id": np.repeat(part["id"].to_numpy(np.int64), BANDS)})

    return reps.select("id", "sig").mapInPandas(run, "key long, id long")


def candidates(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, n, set (sorted 64-bit hashes) of the classes wanted (id, row, cls, copies), each from a text of the row that stands for it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, seen = Powers(), set()
        for rows in batches(frames, 2_000_000):
            sets = distinct_sets(rows["text"].tolist(), powers)
            # of rows that are repeated one a task is enough; another text with an equal key has another digest
            new = [k for k, (i, x, c) in enumerate(zip(rows["id"], sets, rows["cls"], strict=True)) if i not in seen and digest(x) == c]
            new = list({rows["id"].iat[k]: k for k in new}.values())
            seen.update(rows["id"].iloc[new])
            if new:
                yield pd.DataFrame({"id": rows["id"].iloc[new].to_numpy(), "n": [len(sets[k]) for k in new], "set": [sets[k].tobytes() for k in new]})

    rows = lookup_unique(docs.select(row_key().alias("row"), "text"), wanted, "row", "copies").select("id", "cls", "text")
    return rows.mapInPandas(run, "id long, n long, set binary").dropDuplicates(["id"])


_PAIR = "a long, b long, la long, lb long"


def ranked(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, la, lb, shared) with la the smaller label, and their place among those of the same labels: those which share most come first."""
    least, greatest = F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb")
    named = pairs.select("a", "b", least, greatest, "shared").dropDuplicates(["a", "b"])
    place = F.row_number().over(Window.partitionBy("la", "lb").orderBy(F.desc("shared"), F.xxhash64("a", "b"), "a", "b"))
    return named.withColumn("place", place).drop("shared")


def early_shingles(shared: DataFrame, known: DataFrame) -> DataFrame:
    """id, label, n, shingle, rank: the rarest shingles of the documents in shared, as many as decide who may be similar enough.

    Shingles are ranked by how many of these documents have them, rare ones first. Two sets that share enough have their first common
    shingle so early in both ranks that what follows it can still hold the rest. A document of a group of near copies that has too
    many shingles of its own finds no partner here at all, so a group does not cost its square.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i in range(0, len(frame), 500):
                part = frame.iloc[i : i + 500]
                n = part["n"].to_numpy()
                rows = {c: np.repeat(part[c].to_numpy(), n) for c in ("id", "label", "n")}
                yield pd.DataFrame(rows | {"shingle": np.frombuffer(b"".join(part["set"]), np.int64)})

    ids = shared.select("id", "label").distinct()
    rows = cut(known.join(ids, "id").select("id", "label", "n", "set").mapInPandas(run, "id long, label long, n long, shingle long"))
    often = cut(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("often", "shingle"))
    # one without the other's first shingles has at most this rank for its first common one
    early = F.col("rank") * 100 <= F.col("n") * (100 - PER_CENT) + 100
    ranked = cut(lookup_unique(rows, often, "shingle", "often", keep=True).withColumn("rank", rank).where(early & (F.col("often") > 1)).drop("often"))
    drop_cut(rows)
    drop_cut(often)
    return ranked


def meeting(some: DataFrame, early: DataFrame) -> DataFrame:
    """Pairs (a, b, la, lb, shared) of documents that have different labels and may be similar enough, a by its rows in some, b in early."""
    x, y = some.alias("x"), early.alias("y")
    left = F.least(F.col("x.n") - F.col("x.rank"), F.col("y.n") - F.col("y.rank")) + 1
    both = F.col("x.n") + F.col("y.n")
    meets = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label"))
    pairs = x.join(y, meets & (left * (100 + PER_CENT) >= both * PER_CENT))
    named = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.label").alias("la"), F.col("y.label").alias("lb"))
    return named.groupBy("a", "b", "la", "lb").agg(F.count(F.lit(1)).alias("shared"))


def resolved(early: DataFrame, known: DataFrame, tested: list[DataFrame]) -> list[DataFrame]:
    """Links (a, b, la, lb), enough of them to connect all labels in early that any similar pair links; tested: pairs (a, b) of earlier rounds.

    Pairs are listed in portions, of PORTION pairs a row at most first, then each time PORTION times that share or more, until every
    row had its turn. Labels that a portion connects list no more pairs, so a group of near copies is mostly connected by a few.
    """
    links: list[DataFrame] = []
    tested = list(tested)
    done, share = 0, 0.0
    while done < DEALT:
        by_label = early.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n"))
        split = by_label.groupBy("shingle").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("inside"))
        size = split.agg(F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n") - F.col("inside")) / 2).alias("across")).first()
        if not size["across"]:
            break
        share = PORTION * max(size["n"] / size["across"], share)
        upto = min(DEALT, done + max(1, int(share * DEALT)))
        turn = F.pmod(F.xxhash64("shingle", "id"), F.lit(DEALT))
        pairs = meeting(early.where((turn >= done) & (turn < upto)), early)
        if tested:
            pairs = untested(pairs, reduce(DataFrame.unionByName, tested))
        pairs = cut(pairs, 8)
        found = settled(pairs, known)
        links += found
        tested.append(pairs.select("a", "b"))
        done = upto
        if found and done < DEALT:
            to = components(reduce(DataFrame.unionByName, found).select(F.col("la").alias("a"), F.col("lb").alias("b")))
            moved = cut(early.join(to.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to"))
            drop_cut(early)
            early = moved
    drop_cut(early)
    return links


def untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    """The pairs (a, b and more) that are not among the pairs (a, b) of earlier rounds, by one aggregation."""
    more = [c for c in pairs.columns if c not in ("a", "b")]
    old = tested.select("a", "b", *[F.lit(None).cast("long").alias(c) for c in more], F.lit(True).alias("old"))
    both = pairs.withColumn("old", F.lit(False)).unionByName(old)
    return both.groupBy("a", "b").agg(*[F.max(c).alias(c) for c in more], F.max("old").alias("old")).where("NOT old").drop("old")


def confirmed(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b, la, lb) whose full sets have 100 * intersection >= PER_CENT * union."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for x, y in zip(frame["xa"], frame["xb"], strict=True):
                keep.append(similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
            if any(keep):
                yield frame.loc[keep, ["a", "b", "la", "lb"]]

    # Spark bounds the frames by bytes (spark.sql.execution.arrow.maxBytesPerBatch)
    a, b = known.select(F.col("id").alias("a"), F.col("set").alias("xa")), known.select(F.col("id").alias("b"), F.col("set").alias("xb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "la", "lb", "xa", "xb").mapInPandas(run, _PAIR)


def settled(pairs: DataFrame, known: DataFrame) -> list[DataFrame]:
    """Links (a, b, la, lb) among pairs (a, b, la, lb, shared), enough of them to connect all labels that any pair links.

    Of two labels four pairs are checked, then twelve more, and so on until they are connected or no pair is left: labels that many
    pairs link are connected after a few checks.
    """
    placed = cut(ranked(pairs), 8)
    apart = cut(placed.groupBy("la", "lb").agg(F.max("place").alias("n")), 8)
    links: list[DataFrame] = []
    low, high = 0, 4
    while apart.limit(1).count():
        tests = placed.where((F.col("place") > low) & (F.col("place") <= high)).join(apart, ["la", "lb"], "left_semi")
        links.append(cut(confirmed(cut(tests.drop("place"), 8), known), 8))
        # labels that are connected by now need no more checks, nor those of which all pairs are checked
        to = components(reduce(DataFrame.unionByName, links).select(F.col("la").alias("a"), F.col("lb").alias("b")))
        at = lambda c, to=to: to.select(F.col("id").alias(c), F.col("label").alias(f"{c}_to"))
        more = apart.where(F.col("n") > high).join(at("la"), "la", "left").join(at("lb"), "lb", "left")
        apart = cut(more.where(F.coalesce("la_to", "la") != F.coalesce("lb_to", "lb")).select("la", "lb", "n"), 8)
        low, high = high, 4 * high
    drop_cut(placed)
    return links


def whole_groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of frames that are sorted by some columns, no group of these cut in two."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        last = (frame[by] == frame[by].iloc[-1]).all(axis=1).to_numpy()
        if held and not (held[0][by].iloc[0] == frame[by].iloc[0]).all():
            yield pd.concat(held)
            held = []
        if not last.all():
            yield pd.concat([*held, frame[~last]])
            held = []
        held.append(frame[last])
    if held:
        yield pd.concat(held)


def likely(sigs: np.ndarray, n: np.ndarray, band: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of rows a, b that meet in a band: how many positions agree, 0 for pairs that are no candidates or meet in an earlier band."""
    same = sigs[a] == sigs[b]
    agree = same.sum(axis=1)
    agree[(agree < LIKELY) | (np.minimum(n[a], n[b]) * 100 < np.maximum(n[a], n[b]) * PER_CENT)] = 0
    at = np.flatnonzero(agree)
    first = same[at].reshape(-1, BANDS, IN_BAND).all(axis=2).argmax(axis=1)
    agree[at[first != band[a[at]]]] = 0
    return agree


class Roots:
    """The components of rows that are joined one pair after another."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        """Whether they were apart."""
        i, j = self.root(i), self.root(j)
        self.up[i] = j
        return i != j


def listed(rows: DataFrame) -> DataFrame:
    """a, b, first: the likely pairs of rows (key, id, n, sig) under each key; those that are first connect as much as all do."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["key"]):
            key, ids, n, sigs = frame["key"].to_numpy(), frame["id"].to_numpy(), frame["n"].to_numpy(), stacked(frame["sig"])
            band, found = key >> KEY_BITS, []
            for d in range(1, len(key)):
                at = np.flatnonzero(key[d:] == key[:-d])
                if not len(at):
                    break
                agree = likely(sigs, n, band, at, at + d)
                found.append(np.stack([at, at + d, agree], axis=1)[agree > 0])
            if found:
                pairs = np.concatenate(found)
                pairs = pairs[np.argsort(-pairs[:, 2], kind="stable")]
                roots = Roots(len(key))
                first = [roots.join(i, j) for i, j in pairs[:, :2].tolist()]
                x, y = ids[pairs[:, 0]], ids[pairs[:, 1]]
                yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "first": first})

    return rows.select("key", "id", "n", "sig").repartition("key").sortWithinPartitions("key").mapInPandas(run, "a long, b long, first boolean")


def similar(p: np.ndarray, q: np.ndarray) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return 100 * both >= PER_CENT * (len(p) + len(q) - both)


def settled_in_blocks(rows: DataFrame, known: DataFrame, sketched: DataFrame) -> DataFrame:
    """Links (a, b), enough of them to connect all that likely pairs of rows (key, id, n) under each key link; sketched: id, sig."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["key", "i", "j"]):
            for (key, i, j), part in frame.groupby(["key", "i", "j"], sort=False):
                # two blocks meet across, a block by itself within
                block, n, sigs = part["block"].to_numpy(), part["n"].to_numpy(), stacked(part["sig"])
                sets, ids, band = [np.frombuffer(x, np.uint64) for x in part["set"]], part["id"].to_numpy(), np.full(len(part), key >> KEY_BITS)
                found = []
                for x in range(len(part)):
                    y = np.arange(x + 1, len(part))
                    y = y[block[y] != block[x]] if i != j else y
                    agree = likely(sigs, n, band, np.full(len(y), x), y)
                    found.append(np.stack([np.full(len(y), x), y, agree], axis=1)[agree > 0])
                pairs, roots, links = np.concatenate(found), Roots(len(part)), []
                for level in range(POSITIONS, LIKELY - 1, -1):
                    at = np.array([roots.root(x) for x in range(len(part))])
                    here = pairs[pairs[:, 2] == level]
                    for x, y in here[at[here[:, 0]] != at[here[:, 1]], :2].tolist():
                        if roots.root(x) != roots.root(y) and similar(sets[x], sets[y]):
                            roots.join(x, y)
                            links.append((x, y))
                if links:
                    x, y = ids[np.array(links)].T
                    yield pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    size = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    blocks = cut(rows.groupBy("key").agg(size.alias("blocks")), 8)
    dealt = rows.select("key", "id").join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id")
    full = dealt.join(known.join(sketched, "id"), "id")
    return full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(run, "a long, b long")


def linked(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """id, label of the classes (id, row, cls, n, sig, copies) that are linked with others: the components of all links between them."""
    all_keys = cut(keyed(classes))
    counted = all_keys.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("id").alias("least"), F.bit_xor(F.xxhash64("id")).alias("all")).where("held > 1")
    # of keys that the same documents share the one of the earliest band is enough
    counted = cut(counted.groupBy("held", "least", "all").agg(F.min("key").alias("key")).select("key", "held"), 8)
    shared = cut(lookup_unique(all_keys, counted, "key", "held", keep=True))
    most = counted.agg(F.max("held")).first()[0] or 0
    drop_cut(all_keys)
    drop_cut(counted)
    wanted = cut(classes.join(shared.select("id").distinct(), "id", "left_semi"), 8)
    known = cut(candidates(docs, wanted.select("id", "row", "cls", "copies")))
    rows = shared.join(wanted.select("id", "n", "sig"), "id")
    pairs = cut(listed(rows.where(F.col("held") <= FEW)), 8)
    own = pairs.select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb"), "first")
    links = cut(confirmed(own.where("first").drop("first"), known).select("a", "b"), 8)
    if most > FEW:
        hot = cut(rows.where((F.col("held") > FEW) & (F.col("held") <= MANY)).select("key", "id", "n"), 8)
        links = links.unionByName(cut(settled_in_blocks(hot, known, wanted.select("id", "sig")), 8))
        drop_cut(hot)
    labels = cut(components(links), 8)

    def labelled(some: DataFrame, name: str, label: str) -> DataFrame:
        to = labels.select(F.col("id").alias(name), F.col("label").alias("to"))
        return some.drop(label).join(to, name, "left").withColumn(label, F.coalesce("to", name)).drop("to")

    apart = labelled(labelled(own.where("NOT first").drop("first"), "a", "la"), "b", "lb").where("la <> lb")
    more = [cut(confirmed(apart, known), 8)]
    if most > MANY:
        huge = labelled(shared.where(F.col("held") > MANY).select("id").distinct(), "id", "label")
        more += resolved(early_shingles(huge, known), known, [])
    more = reduce(DataFrame.unionByName, more).select("a", "b")
    if more.limit(1).count():
        labels = components(links.unionByName(more))
    for done in (shared, wanted, known, pairs):
        drop_cut(done)
    return labels


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, n, cls) and classes (id, cls, copies, label): texts with equal sets are one class, linked classes share a label."""
    rows = cut(sketches(docs))
    # equal sets have equal sizes and signatures; any row of the class can stand for it
    classes = rows.where("cls IS NOT NULL").groupBy("cls", "n", "sig").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    labels = linked(docs, classes)
    return rows.select("doc_id", "row", "n", "cls"), cut(classes.join(labels, "id", "left").select("id", "cls", "copies", F.coalesce("label", "id").alias("label")))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Texts with equal sets are one class, compared once, so repeated rows and ties cost nothing. Rows without words (null, empty or
    white texts) are their own component. A doc_id with several texts is one document, linked by each of them. Rows with a null
    doc_id link others by their text like any row, and get the component_id of those, or none where no row there has an id; they are
    kept only there. Long texts go through whole, one text at a time. An empty table gives an empty result; other columns play no part.
    """
    rows, classes = classified(docs)
    found = cut(lookup_unique(rows.where("cls IS NOT NULL"), classes, "cls", "copies").select("doc_id", "n", "label"))
    # documents with several texts link the components of these
    per_id = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("doc_id", "a")
    more = cut(found.select("doc_id", F.col("label").alias("b")).join(per_id, "doc_id").select("a", "b").where("a <> b").distinct(), 8)
    by_label = cut(found.groupBy("label").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    if more.limit(1).count():
        joined = components(more).select(F.col("id").alias("label"), F.col("label").alias("root"))
        rooted = cut(by_label.join(joined, "label", "left").withColumn("root", F.coalesce("root", "label")))
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        by_label = cut(rooted.join(least, "root").select("label", "component_id", "rows"))
    else:
        by_label = by_label.withColumnRenamed("least", "component_id")
    both = lookup_unique(found, by_label, "label", "rows").select("doc_id", "n", "component_id")
    both = both.unionByName(rows.where("cls IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return both.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies: that of the smallest doc_id, one without an id only where no row there has one.

    Texts alone link rows here, so a second text under an id stays where it has no copy. Rows without words are their own groups,
    but rows that are repeated, with the same id and text, stay once; those without id and words all stay.
    """
    rows, classes = classified(docs)
    found = lookup_unique(rows.where("cls IS NOT NULL"), classes, "cls", "copies").select("doc_id", "row", "label")
    choice = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    stay = found.groupBy("label").agg(F.min(choice).alias("c")).select(F.col("c.row").alias("_row"))
    stay = stay.unionByName(rows.where("cls IS NULL AND doc_id IS NOT NULL").select(F.col("row").alias("_row"))).distinct()
    nameless = F.col("doc_id").isNull() & (F.btrim(F.coalesce("text", F.lit("")), F.lit(WHITE)) == "")
    marked = docs.where(~nameless).select(row_key().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    copies = rows.groupBy(F.col("row").alias("_row")).agg(F.count(F.lit(1)).alias("_copies"))
    stay = cut(stay.join(copies, "_row"))
    once, repeated = stay.where("_copies = 1"), stay.where("_copies > 1")
    kept = marked.join(once, "_row", "left_semi")
    again = lookup_unique(marked, cut(repeated), "_row", "_copies").dropDuplicates(["_row"])
    return kept.select("_doc.*").unionByName(again.select("_doc.*")).unionByName(docs.where(nameless))


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] FOR i IN range(1, len(w) - 3)]) END AS g FROM t),
u AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n, md5(array_to_string(list_sort(g), chr(10))) AS c, g FROM s),
k AS (SELECT c, min(doc_id) AS id, any_value(n) AS n, any_value(g) AS g FROM u WHERE n > 0 GROUP BY c),
e AS (SELECT id, n, unnest(g) AS x FROM k),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.id < b.id
      WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 75 * (na + nb - i)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS reach FROM k UNION SELECT d.b, r.reach FROM r JOIN d ON r.id = d.a WHERE r.reach < d.b),
m AS (SELECT id, min(reach) AS component FROM r GROUP BY id)
SELECT u.doc_id, u.n AS n_shingles, coalesce(m.component, u.doc_id) AS component_id, u.doc_id = coalesce(m.component, u.doc_id) AS kept
FROM u LEFT JOIN k ON u.c = k.c AND u.n > 0 LEFT JOIN m USING (id)
"""

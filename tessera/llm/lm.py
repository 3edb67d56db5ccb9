"""Language-model scores of whole texts.

A text's tokens are its words and one end. A word is read as its subword ids: the longest entry of a public vocabulary that begins it,
then the longest that begins the rest, and so on. Causal self-attention over the subword ids of the tokens before predicts the next
token by a tree of two levels: first a group of leading ids, by attention, then the word within its group, by its share of the group's
training tokens. Frequent leading ids are groups of their own, others share groups of about equal weight. The base score takes words
alone. Both count tokens that training never saw as half a token.

Word counts are a table. Words with a millionth of all tokens or more, a million of them at most by arithmetic, are broadcast; all
others reach their documents by a join, in which no key is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.attention import ROWS, WINDOW, Attention, Pieces, windows
from tessera.llm.bpe import VOCABULARY, read_ranks
from tessera.llm.common import Powers, batches, by_document, cut, prefix_sums, stretch_hashes, word_hashes

#: Groups of leading ids; the last is that of the end, and ids that training never saw are in group 0.
LEADING = 62
CLASSES, END_CLASS = LEADING + 1, LEADING
END = np.uint64(0xE7D)
MOST_HOT = 1_000_000
#: Every training document trains the attention weights once, in one of ROUNDS rounds. A round deals its documents to shards of about
#: SHARD tokens by a hash of the row; each shard trains a model, BATCH windows a step, and the mean of these is where the next begins.
ROUNDS, SHARD, BATCH = 2, 2_000_000, 64
#: Characters of a shard that are tokenised at once.
AT_ONCE = 500_000
LONGEST_ID, LONGEST_PART = 6, 64
#: Ids below it, the most frequent, have their own row of embeddings; the others share the rest.
OWN_ROWS = 3072


@lru_cache(2)
def _entries(path: str) -> list[tuple]:
    """Of the vocabulary's entries that begin words, then of those that go on with them: sorted hashes, their ids, the lengths there are,
    where the hashes with each choice of the 20 leading bits begin, and how many those are at most."""
    ranks, out = sorted(read_ranks(path).items(), key=lambda x: x[1]), []
    powers = Powers()
    for leading in (True, False):
        found: dict[bytes, int] = {}
        for piece, rank in ranks:
            spaced = piece[:1] == b" " and len(piece) > 1
            bare = piece[1:] if spaced and leading else piece
            if len(bare) <= LONGEST_ID and not any(c in b" \t\n\x0b\x0c\r" for c in bare) and (spaced or not leading or len(piece) == 1):
                found[bare] = rank
        joined, ends = b"".join(found), np.cumsum([len(x) for x in found])
        starts = ends - [len(x) for x in found]
        hashes = stretch_hashes(prefix_sums(np.frombuffer(joined, np.uint8), powers), starts, ends, powers)
        order = np.argsort(hashes)
        slots = np.searchsorted(hashes[order] >> np.uint64(44), np.arange(2**20 + 1, dtype=np.uint64)).astype(np.int32)
        most = int(np.diff(slots).max())
        ids = np.array(list(found.values()), np.int32)[order]
        out.append((np.append(hashes[order], np.zeros(most, np.uint64)), ids, sorted({len(x) for x in found}, reverse=True), slots, most))
    return out


def _longest(starts: np.ndarray, ends: np.ndarray, sums: np.ndarray, powers: Powers, entries: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Id and length of the longest entry that begins each stretch raw[start:end]; every byte is an entry."""
    hashes, ids, lengths, slots, most = entries
    out, long, left = np.zeros(len(starts), np.int32), np.ones(len(starts), np.int64), np.arange(len(starts))
    for n in lengths:
        here = ends[left] - starts[left] >= n
        fits = left[here]
        h = stretch_hashes(sums, starts[fits], starts[fits] + n, powers)
        at = slots[h >> np.uint64(44)]
        for _ in range(most - 1):
            at += hashes[at] < h
        hit = hashes[at] == h
        out[fits[hit]], long[fits[hit]] = ids[at[hit]], n
        here[here] = hit
        left = left[~here]
    return out, long


def subword_ids(starts: np.ndarray, ends: np.ndarray, sums: np.ndarray, powers: Powers, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The subword ids of the words raw[start:end] end to end, and how many each has. Long words are read LONGEST_PART bytes at a time."""
    first, rest = _entries(path)
    parts = np.maximum(1, -(-(ends - starts) // LONGEST_PART))
    word = np.repeat(np.arange(len(starts)), parts)
    turn = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = starts[word] + turn * LONGEST_PART
    end = np.minimum(begin + LONGEST_PART, ends[word])
    ids, whose, places = [], [], []
    left = np.arange(len(word))
    step = 0
    while len(left):
        is_first = (turn[left] == 0) & (step == 0)
        found, long = np.zeros(len(left), np.int32), np.ones(len(left), np.int64)
        for entries, chosen in ((first, is_first), (rest, ~is_first)):
            if chosen.any():
                found[chosen], long[chosen] = _longest(begin[left[chosen]], end[left[chosen]], sums, powers, entries)
        ids.append(found)
        whose.append(word[left])
        places.append(begin[left])
        begin[left] += long
        left = left[begin[left] < end[left]]
        step += 1
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    order = np.lexsort((np.concatenate(places), np.concatenate(whose)))
    return np.concatenate(ids)[order], np.bincount(np.concatenate(whose), minlength=len(starts))


class Tokens:
    """Texts as tokens: distinct words' hashes (the end last), their subword ids, each token's place among them, tokens a text (the end too)."""

    def __init__(self, texts: list[str | None], powers: Powers, path: str, whole: bool = True) -> None:
        hashes, counts, starts, ends, sums = word_hashes(texts, powers, places=True)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        n = len(distinct)
        if not whole:
            self.ids, self.sizes = (_longest(starts[first], ends[first], sums, powers, _entries(path)[0])[0] if n else np.zeros(0, np.int32)), np.ones(n, np.int64)
        else:
            self.ids, self.sizes = subword_ids(starts[first], ends[first], sums, powers, path)
        self.words = np.append(distinct, END)
        self.leading = np.append(self.ids[np.cumsum(self.sizes) - self.sizes], np.int32(-1)) if n else np.full(1, -1, np.int32)
        self.lengths = counts + 1
        self.tokens = np.full(self.lengths.sum(), n, np.int64)
        is_word = np.ones(len(self.tokens), bool)
        is_word[np.cumsum(self.lengths) - 1] = False
        self.tokens[is_word] = back
        self.text = np.repeat(np.arange(len(self.lengths)), self.lengths)

    def pieces(self) -> Pieces:
        """Rows of embeddings of the words, of the end, which is never read, and of what stands before a text."""
        ids = self.ids.astype(np.int64)
        rows = np.where(ids < OWN_ROWS, ids, OWN_ROWS + ids * 40503 % 65521 % (ROWS - OWN_ROWS))
        return Pieces(np.concatenate([rows, [0, ROWS]]), np.concatenate([self.sizes, [1, 1]]))


def remainder(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def counts(docs: DataFrame, path: str) -> DataFrame:
    """word, id, trained (occurrences in training documents), n (in all)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        for rows in batches(frames, 2_000_000):
            t = Tokens(rows["text"].tolist(), powers, path, whole=False)
            learn = rows["learn"].to_numpy(bool)[t.text]
            n, trained = np.bincount(t.tokens, minlength=len(t.words)), np.bincount(t.tokens[learn], minlength=len(t.words))
            yield pd.DataFrame({"word": t.words.view(np.int64), "id": t.leading, "trained": trained, "n": n})

    rows = docs.select("text", (remainder(F.col("doc_id")) != 1).alias("learn"))
    found = rows.mapInPandas(run, "word long, id int, trained long, n long")
    return found.groupBy("word").agg(F.max("id").alias("id"), F.sum("trained").alias("trained"), F.sum("n").alias("n"))


def _sharded(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[str]]]:
    """Shard and texts of about AT_ONCE characters, of frames that are sorted by shard; alike however the rows are cut into frames."""
    texts, held, shard = [], 0, None
    for frame in frames:
        for s, t in zip(frame["shard"].tolist(), frame["text"].tolist(), strict=True):
            if texts and (s != shard or held >= AT_ONCE):
                yield shard, texts
                texts, held = [], 0
            shard = s
            texts.append(t)
            held += len(t or "")
    if texts:
        yield shard, texts


#: Weights are summed as whole numbers of this fraction, so that their means don't depend on the order.
GRAIN = 2**24


def trained(docs: DataFrame, class_of: np.ndarray, shares: np.ndarray, path: str, tokens: int = 0) -> np.ndarray:
    """Weights of the attention model, learned from every training document, null ids too, once; tokens: how many there are.

    Shards, their order and the means of their weights depend on the rows alone, not on partitions.
    """
    weights = Attention(CLASSES, shares=shares).flat
    shards = -(-tokens // (SHARD * ROUNDS)) or 1
    key = F.xxhash64("doc_id", "text")
    learn = docs.where(remainder(F.col("doc_id")) != 1).select("text", key.alias("key"), F.pmod(key, F.lit(ROUNDS)).alias("turn"), F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"))
    for turn in range(ROUNDS):

        def run(frames: Iterator[pd.DataFrame], start: np.ndarray = weights, turn: int = turn) -> Iterator[pd.DataFrame]:
            powers, model, shard, state, steps = Powers(), None, None, {}, 0

            def done() -> pd.DataFrame:
                return pd.DataFrame({"i": np.arange(len(model.flat)), "w": np.round(model.flat.astype(np.float64) * GRAIN).astype(np.int64) * steps, "n": steps})

            for s, texts in _sharded(frames):
                if s != shard:
                    if steps:
                        yield done()
                    model, shard, state, steps = Attention(CLASSES, start), s, {}, 0
                t = Tokens(texts, powers, path)
                pieces, groups = t.pieces(), class_of[t.leading][t.tokens]
                inputs, at, _ = windows(t.tokens, t.lengths, len(pieces.counts) - 1, WINDOW)
                order = np.random.default_rng(turn).permutation(len(inputs))
                for i in range(0, len(order), BATCH):
                    part = order[i : i + BATCH]
                    model.train_step(inputs[part], groups[np.maximum(at[part], 0)], at[part] >= 0, state, pieces=pieces)
                    steps += 1
            if steps:
                yield done()

        rows = learn.where(F.col("turn") == turn).select("shard", "key", "text").repartition("shard").sortWithinPartitions("shard", "key").select("shard", "text")
        sums = rows.mapInPandas(run, "i int, w long, n long").groupBy("i").agg(F.sum(F.col("w").cast("decimal(38,0)")).alias("w"), F.sum("n").alias("n")).collect()
        if not sums:
            continue
        weights = np.zeros(len(weights), np.float32)
        weights[[r["i"] for r in sums]] = [float(r["w"]) / r["n"] / GRAIN for r in sums]
    return weights


def grouped(counts_by_id: dict[int, int]) -> np.ndarray:
    """The group of each leading id; the last entry is that of the end, -1. Ids in order of frequency fill groups of equal weight."""
    class_of = np.zeros(max([60_000, *(i + 1 for i in counts_by_id)]) + 1, np.int64)
    order = sorted((i for i in counts_by_id if i >= 0), key=lambda i: (-counts_by_id[i], i))
    left, group, held = sum(counts_by_id[i] for i in order), 0, 0
    for i in order:
        if held and group < LEADING - 1 and held + counts_by_id[i] / 2 > left / (LEADING - group):
            left -= held
            group, held = group + 1, 0
        class_of[i] = group
        held += counts_by_id[i]
    class_of[-1] = END_CLASS
    return class_of


def query(docs: DataFrame, path: str | None = None) -> DataFrame:
    """A row a document: counts, base score and model score.

    Null, empty and white texts have an end alone. Repeated rows come out alike. Null ids are scored, and learned from as if their id
    were empty text. Long texts are scored whole, window by window. Other columns play no part, whatever their names. An empty table
    gives an empty result; without training documents the model is that of the start. Scores depend on the rows alone, up to the
    rounding of single precision.
    """
    vocabulary = path or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    table = cut(counts(docs, vocabulary))
    total = table.agg(F.coalesce(F.sum("trained"), F.lit(0)).alias("N"), F.count(F.when(F.col("trained") > 0, 1)).alias("V"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    # a row a subword id: no more than the vocabulary has
    by_id = table.groupBy("id").agg(F.sum("trained").alias("c"), F.count(F.when(F.col("trained") > 0, 1)).alias("v")).collect()
    class_of = grouped({r["id"]: r["c"] for r in by_id})
    in_class, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_id:
        in_class[class_of[r["id"]]] += r["c"]
        kinds[class_of[r["id"]]] += r["v"]
    weights = trained(docs, class_of, (in_class + 0.5) / (in_class + 0.5).sum(), vocabulary, total["N"])
    hot = table.where(F.col("n") * MOST_HOT >= total["all"]).select("word", "trained").toPandas()
    order = np.argsort(hot["word"].to_numpy(np.int64).view(np.uint64))
    hot_words, hot_counts = hot["word"].to_numpy(np.int64).view(np.uint64)[order], hot["trained"].to_numpy(np.int64)[order]
    sent = spark.sparkContext.broadcast((hot_words, hot_counts, weights, class_of, np.log10(in_class + 0.5 * (kinds + 1))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hot_words, hot_counts, weights, class_of, log_class = sent.value
        model, powers = Attention(CLASSES, weights), Powers()
        for rows in batches(frames, 2_000_000):
            t = Tokens(rows["text"].tolist(), powers, vocabulary)
            words, tokens, lengths, text = t.words, t.tokens, t.lengths, t.text
            classes = class_of[t.leading][tokens]
            logs = model.score(tokens, lengths, classes, t.pieces()).astype(np.float64) / np.log(10) - log_class[classes]
            at = np.minimum(np.searchsorted(hot_words, words), max(0, len(hot_words) - 1))
            is_hot = hot_words[at] == words if len(hot_words) else np.zeros(len(words), bool)
            c = np.where(is_hot, hot_counts[at], 0) if len(hot_words) else np.zeros(len(words), np.int64)
            hot_token = is_hot[tokens]
            sums = lambda x: np.bincount(text, x, minlength=len(rows))  # noqa: E731, B023
            rare = np.flatnonzero(~hot_token)
            pairs, n = np.unique(text[rare] * np.int64(len(words)) + tokens[rare], return_counts=True)
            ends = np.searchsorted(pairs // len(words), np.arange(1, len(rows)))
            yield pd.DataFrame({
                "doc_id": rows["doc_id"].to_numpy(), "held_out": rows["held_out"].to_numpy(), "n_tokens": lengths,
                "known": sums((hot_token & (c[tokens] > 0)).astype(float)).astype(np.int64), "hot_log": sums(np.where(hot_token, np.log10(c + 0.5)[tokens], 0.0)),
                "class_log": sums(logs), "rare": np.split(words[pairs % len(words)].view(np.int64), ends), "times": np.split(n.astype(np.int32), ends),
            })

    rows = docs.select("doc_id", "text", (remainder(F.col("doc_id")) == 1).alias("held_out"))
    schema = "held_out boolean, n_tokens long, known long, hot_log double, class_log double, rare array<long>, times array<int>"
    scored = cut(by_document(rows, run, schema).withColumn("row", F.monotonically_increasing_id()))
    each = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("t")).select("row", F.col("t.rare").alias("word"), F.col("t.times").alias("times"))
    cold = table.where(F.col("n") * MOST_HOT < total["all"]).select("word", "trained")
    per_row = each.join(cold, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("trained") + 0.5)).alias("rare_log"), F.sum(F.when(F.col("trained") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    whole = F.lit(float(np.log10(total["N"] + 0.5 * (total["V"] + 1))))
    logs = F.col("hot_log") + F.coalesce("rare_log", F.lit(0.0))
    return scored.drop("rare", "times").join(per_row, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(total["N"]).cast("long").alias("train_tokens"), (logs - F.col("n_tokens") * whole).alias("base_score"), (logs + F.col("class_log")).alias("score"),
    )

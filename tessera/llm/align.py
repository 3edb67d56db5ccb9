"""Cross-tokenizer alignment by a label string: each byte of a text is the end of an A token, of a B token, of both or of none.

A regular expression cuts the labels into spans up to each byte where both end; the labels in a span tell how many tokens of either
side make up that group. Walking along a span's labels gives the overlapping pairs. How many documents hold a pair follows from
one aggregation over blocks of documents, each of which names a pair once; the counts go back to the blocks, not to every link.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, count

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import byte_symbols
from tessera.llm.common import batches, cut, lookup_unique

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Stretches of text that a worker remembers, twice at most, and the longest of these in characters.
REMEMBERED, LONGEST = 150_000, 48
#: Characters of a block of documents; a longer text is a block of its own.
BLOCK = 4_000_000

NONE, A_END, B_END, BOTH = b".abx"
_SPAN = re.compile(rb"[^x]*x")
_ODD_SPACE, _LONE_SPACE = re.compile(r"\s\s|\s$"), re.compile(r"(?<=\S) (?=\S)")


def labels(a: np.ndarray, b: np.ndarray, size: int) -> bytes:
    """The label of each of `size` bytes, from the numbers of bytes of the tokens of either side."""
    out = np.full(size, NONE, np.uint8)
    out[np.cumsum(a) - 1] = A_END
    ends = np.cumsum(b) - 1
    out[ends] = np.where(out[ends] == A_END, BOTH, B_END)
    return out.tobytes()


def groups(marks: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The labels that end a token, and of each group how many of them its span has, and where it ends among them."""
    ends = marks.translate(None, bytes([NONE]))
    sizes = np.fromiter(map(len, _SPAN.findall(ends)), np.int64)
    return np.frombuffer(ends, np.uint8), sizes, np.cumsum(sizes) - 1


class Aligner:
    """Aligns stretches of text that begin with a space, or with a line feed where the pieces have none.

    Neither side's tokens pass over a space or line feed that stands alone between other characters, and the token after it begins with
    it, so what lies between such can be encoded and aligned by itself.
    """

    def __init__(self, a_path: str, b_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {s: i for i, s in enumerate(byte_symbols())}
        self.a_bytes = {i: bytes(byte_of[c] for c in p) if all(c in byte_of for c in p) else p.encode() for p, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        # a line feed is a byte by itself for the pieces, behind a space of their own
        self.lines = not any("\n" in p for p in pieces) and self.b_bytes[self.b.encode("\n")[0]] == b" "
        self.known: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def stretches(self, text: str) -> list[str]:
        """The parts of a text, with a space before it."""
        if text[:1].isspace() or _ODD_SPACE.search(text):
            return [" " + p for p in _LONE_SPACE.split(text)]
        parts = text.replace("\n", " \n").split(" ") if self.lines else text.split(" ")
        return [p if p[:1] == "\n" and self.lines else " " + p for p in parts]

    def learn(self, new: list[str]) -> dict[str, tuple | None]:
        """Of each stretch n_a, n_b, n_groups, the groups as text and the links as bytes of pairs (a << 32 | b); None where the bytes differ.

        All are laid end to end: as both sides end a token at the end of each, no group passes from one to the next.
        """
        found: dict[str, tuple | None] = {s: None for s in new if "▁" in s}  # which the pieces take for a space
        new = [s for s in new if "▁" not in s]
        if not new:
            return found
        a, b = [x.ids for x in self.a.encode_batch_fast(new, add_special_tokens=False)], self.b.encode([s.removeprefix(" ") for s in new], num_threads=1)
        b = [y if s[0] == " " else y[1:] for s, y in zip(new, b, strict=True)]  # the pieces' own space goes where there is none
        n, m = np.fromiter(map(len, a), np.int64), np.fromiter(map(len, b), np.int64)
        x, y = np.fromiter(chain.from_iterable(a), np.int64, n.sum()), np.fromiter(chain.from_iterable(b), np.int64, m.sum())
        a, b = x.tolist(), y.tolist()
        raw = "".join(new).encode()
        if b"".join([self.a_bytes[i] for i in a]) != raw or b"".join([self.b_bytes[i] for i in b]) != raw:
            if len(new) == 1:
                return found | {new[0]: None}
            return found | self.learn(new[: len(new) // 2]) | self.learn(new[len(new) // 2 :])
        ends, _, last = groups(labels(self.a_sizes[x], self.b_sizes[y], len(raw)))
        a_ends, b_ends = np.cumsum(ends != B_END), np.cumsum(ends != A_END)
        # up to each label the tokens that it stands in overlap
        links = (x[a_ends - (ends != B_END)] << 32 | y[b_ends - (ends != A_END)]).tobytes()
        said, i, j = [], 0, 0
        for p, q in zip(a_ends[last].tolist(), b_ends[last].tolist(), strict=True):
            if p - i == q - j == 1:
                said.append(f"{a[i]}|{b[j]}")
            else:
                said.append(f"{','.join(map(str, a[i:p]))}|{','.join(map(str, b[j:q]))}")
            i, j = p, q
        group = np.searchsorted(a_ends[last], np.cumsum(n)) + 1
        link = (last[group - 1] + 1) * 8
        g = k = 0
        for s, n_a, n_b, h, e in zip(new, n.tolist(), m.tolist(), group.tolist(), link.tolist(), strict=True):
            found[s] = (n_a, n_b, h - g, ";".join(said[g:h]), links[k:e])
            g, k = h, e
        return found

    def align(self, stretches: Iterable[str]) -> list[tuple | None]:
        """What learn() says of each of the stretches, which are distinct."""
        stretches = list(stretches)
        found = {}
        new = []
        for s in stretches:
            if s in self.known:
                continue
            if s in self.older:
                found[s] = self.older[s]
            else:
                new.append(s)
        for i in range(0, len(new), 5000):
            found |= self.learn(new[i : i + 5000])
        out = [found[s] if s in found else self.known[s] for s in stretches]
        # what was not met since the memory was last full is forgotten when it is full again
        for s, x in found.items():
            if len(s) <= LONGEST:
                if len(self.known) >= REMEMBERED:
                    self.known, self.older = {}, self.known
                self.known[s] = x
        return out


def _block(texts: list[str], aligner: Aligner) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Rows (n_a, n_b, n_groups, n_links, groups, pair, times) of documents, the block's pairs in order, and in how many documents each is."""
    number: defaultdict[str, int] = defaultdict(count().__next__)
    cut = [np.fromiter(map(number.__getitem__, aligner.stretches(t)), np.int64) if t else np.zeros(0, np.int64) for t in texts]
    found = aligner.align(number)
    spelled = np.fromiter((x is not None for x in found), bool, len(found))
    n_a, n_b, n_groups, said, links = zip(*[x or (0, 0, 0, "", b"") for x in found], strict=True) if found else [()] * 5
    figures = np.array([n_a, n_b, n_groups], np.int64)
    size = np.fromiter(map(len, links), np.int64, len(links)) // 8
    pairs, code = np.unique(np.frombuffer(b"".join(links), np.int64), return_inverse=True)
    start = np.cumsum(size) - size
    rows, docs = [], np.zeros(len(pairs), np.int64)
    for at in cut:
        if not len(at) or not spelled[at].all():
            rows.append((0, 0, 0, 0, "", b"", b""))
            continue
        n = size[at]
        total = int(n.sum())
        where = np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(total)
        pair, times = np.unique(code[where], return_counts=True)
        docs[pair] += 1
        text = ";".join(map(said.__getitem__, at.tolist()))
        rows.append((*figures[:, at].sum(axis=1).tolist(), total, text, pair.astype(np.uint32).tobytes(), times.astype(np.uint32).tobytes()))
    used = docs > 0  # a stretch of a text that is left out may have brought in others
    to = np.cumsum(used) - 1
    rows = [(*r[:5], to[np.frombuffer(r[5], np.uint32)].astype(np.uint32).tobytes(), r[6]) for r in rows]
    return rows, pairs[used], docs[used]


_DOC = "block long, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Blocks of documents: rows of documents (their figures, groups, pair and times, numbering the block's pairs) and one row of the block (pairs, held).

    groups has the token ids as `a1,a2|b1;a3|b2,b3`, groups_sha256 its digest. The paths must be readable where tasks run, as the
    files of an installed package are. Texts that are null, empty, or that the tokens of a side do not spell (such as those with
    U+2581) have no tokens: zeros. Very long texts and stretches go through whole.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner = Aligner(a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE))
        block = TaskContext.get().partitionId() << 32
        for rows in batches(frames, BLOCK):
            out, pairs, held = _block([t or "" for t in rows["text"]], aligner)
            frame = pd.DataFrame(out, columns=["n_a", "n_b", "n_groups", "n_links", "groups", "pair", "times"])
            frame["groups_sha256"] = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in frame["groups"]]
            frame["doc_id"] = rows["doc_id"].to_numpy()
            own = pd.DataFrame({"pairs": [pairs.tobytes()], "held": [held.tobytes()]})
            yield pd.concat([frame, own]).assign(block=block)[[c.split()[0] for c in schema.split(", ")]]
            block += 1

    schema = f"{_DOC}, groups string, pair binary, times binary, pairs binary, held binary"
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, schema)


def _pairs(blocks: DataFrame) -> DataFrame:
    """block, pair, docs: the pairs of each block and how many of its documents hold them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for block, pairs, held in zip(frame["block"], frame["pairs"], frame["held"], strict=True):
                yield pd.DataFrame({"block": block, "pair": np.frombuffer(pairs, np.int64), "docs": np.frombuffer(held, np.int64)})

    return blocks.where("pairs IS NOT NULL").select("block", "pairs", "held").mapInPandas(run, "block long, pair long, docs long")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (a << 32 | b), count (documents that hold it), blocks (that name it), best (no pair of its A id has a higher count)."""
    counts = cut(_pairs(blocks).groupBy("pair").agg(F.sum("docs").alias("count"), F.count(F.lit(1)).alias("blocks")))
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))  # a row an A id: bounded by the vocabulary
    return counts.withColumn("a", a).join(F.broadcast(most), "a").select("pair", "count", "blocks", (F.col("count") == F.col("most")).alias("best"))


def query(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs; cases as in aligned().

    Each row counts as a document, repeated rows and null ids too. Other columns play no part; an empty table gives an empty result.
    """
    blocks = cut(aligned(docs, a_path, b_path).drop("groups"))
    counted = cut(pair_counts(blocks))
    # each block gets the counts of its own pairs; a pair that all blocks name is looked up by broadcast
    found = lookup_unique(_pairs(blocks).drop("docs"), counted, "pair", "blocks")
    rows = blocks.where("pairs IS NULL").drop("pairs", "held")

    def run(own: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.sort_values("pair")
        count, best = pairs["count"].to_numpy(np.int64), pairs["best"].to_numpy(bool)
        sums = []
        for at, times in zip(own["pair"], own["times"], strict=True):
            k, n = np.frombuffer(at, np.uint32), np.frombuffer(times, np.uint32).astype(np.int64)
            sums.append((int(n[best[k]].sum()), int((n * count[k]).sum())))
        own = own.drop(columns=["pair", "times"])
        own["n_best"], own["count_sum"] = [s[0] for s in sums], [s[1] for s in sums]
        return own

    out = rows.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(run, f"{_DOC}, n_best long, count_sum long")
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")

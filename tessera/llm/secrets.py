"""Secret scans by grammar inference.

Labelled credentials are held in a prefix tree over kinds of characters, with the characters themselves counted at each state. States
whose continuations don't differ more than chance allows are merged, which leaves a probabilistic automaton a label: fixed parts of a
format keep states of their own, random parts share one. Labels are what the base patterns find in the documents, and generated
credentials of public formats. Every candidate, a run of credential characters, is scored by its likelihood under each automaton
against that of ordinary runs. Fixed patterns find the base spans.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import batches, by_document, cut

# Fixed patterns of the base spans, in order; a match whose tested group is shorter is dropped.
BASE = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}"), 0, 24),
)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
#: Characters of credentials, by kind; automata change states by kind and weigh the characters of a kind at each state.
KINDS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+", "/", "_", ".", "=", "-")
#: Natural logarithm of the likelihood ratio from which a candidate is taken: in all, and a character. Candidates are the runs of at
#: least SHORTEST such characters; no format has shorter ones.
LEAST_TOTAL, LEAST_RATIO, SHORTEST = 18.0, 0.5, 8
#: Longer runs are scored in parts of so many characters.
PART = 512
#: Allowed chance of holding two alike states apart, and generated samples a label, seeded.
ALPHA, SAMPLES, SEED = 0.05, 300, 20240131
#: Values of a label that are learned from the documents at most, those with the least hashes of all documents' values, and at least.
LEARNED, LEAST_LEARNED = 1000, 30

_HEX, _UPPER, _LOWER, _DIGIT = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM = _UPPER + _LOWER + _DIGIT


_CHARACTERS = "".join(KINDS)
_CODE = {c: i for i, c in enumerate(_CHARACTERS)}
_KIND = {c: k for k, chars in enumerate(KINDS) for c in chars}
END = len(KINDS)


def labelled(seed: int = SEED, n: int = SAMPLES) -> dict[str, list[str]]:
    """Credentials of public formats by label, and ordinary identifiers under "ordinary"; none is real."""
    rnd = random.Random(seed)
    draw = lambda chars, k: "".join(rnd.choices(chars, k=k))
    syllables = "an ber che de er for ge ing ja ko la men ne on pre que re sti tion un ver wo".split()
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(2, 4)))
    out = {
        "hex": [draw(_HEX, rnd.choice((32, 40, 64))) for _ in range(n)],
        "cloud_id": [rnd.choice(("AKIA", "ASIA")) + draw(_UPPER + _DIGIT, 16) for _ in range(n)],
        "cloud_secret": [draw(_ALNUM + "+/", 40) for _ in range(n)],
        "prefixed": [rnd.choice(("ghp_", "gho_", "ghs_")) + draw(_ALNUM, 36) for _ in range(n)],
        "payment": [rnd.choice(("sk_live_", "rk_live_", "sk_test_")) + draw(_ALNUM, 24) for _ in range(n)],
        "maps": ["AIza" + draw(_ALNUM + "_-", 35) for _ in range(n)],
        "chat": [rnd.choice(("xoxb-", "xoxp-")) + draw(_DIGIT, 12) + "-" + draw(_DIGIT, 12) + "-" + draw(_ALNUM, 24) for _ in range(n)],
        "web_token": [".".join(("eyJ" + draw(_ALNUM + "_-", rnd.randint(30, 40)), "eyJ" + draw(_ALNUM + "_-", rnd.randint(40, 90)), draw(_ALNUM + "_-", 43))) for _ in range(n)],
    }
    ordinary = (
        lambda: "".join(word() for _ in range(4)),
        lambda: "_".join(word() for _ in range(rnd.randint(3, 5))),
        lambda: "-".join(word() for _ in range(rnd.randint(3, 5))),
        lambda: "/".join(word() for _ in range(rnd.randint(3, 6))) + rnd.choice(("", ".html", ".txt", ".py")),
        lambda: "".join(word().capitalize() for _ in range(4)),
        lambda: ".".join(word() for _ in range(4)),
        lambda: draw(_DIGIT, rnd.randint(16, 24)),
        lambda: "_".join(word().upper() for _ in range(3)),
        lambda: rnd.choice("-=._") * rnd.randint(16, 60),
        lambda: rnd.choice(_ALNUM) * rnd.randint(8, 60),
        lambda: draw(draw(_LOWER, rnd.randint(2, 26)), rnd.randint(8, 40)),
        lambda: "".join(word() for _ in range(3)).upper() + draw(_DIGIT, rnd.randint(0, 4)),
    )
    out["ordinary"] = [make() for _ in range(n) for make in ordinary]
    return out


class Automaton:
    """A deterministic probabilistic automaton, inferred by merging states of a prefix tree."""

    def __init__(self, samples: list[str], alpha: float = ALPHA) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.count: list[Counter] = [Counter()]
        self.chars: list[Counter] = [Counter()]
        for s in samples:
            at = 0
            for c in s:
                k = _KIND[c]
                self.count[at][k] += 1
                self.chars[at][c] += 1
                if k not in self.next[at]:
                    self.next[at][k] = len(self.next)
                    self.next.append({})
                    self.count.append(Counter())
                    self.chars.append(Counter())
                at = self.next[at][k]
            self.count[at][END] += 1
        self.size = [c.total() for c in self.count]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()
        self._tabulate()

    def _alike(self, a: int, b: int) -> bool:
        """Hoeffding's bound on each frequency, for the states and, recursively, what follows them."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.size[a], self.size[b]
            most = self.bound * (n**-0.5 + m**-0.5)
            if most >= 1:  # frequencies of so few don't differ by chance
                pass
            elif any(abs(x.get(c, 0) / n - y.get(c, 0) / m) > most for x, y in ((self.count[a], self.count[b]), (self.chars[a], self.chars[b])) for c in {**x, **y}):
                return False
            todo += [(self.next[a][c], self.next[b][c]) for c in self.next[a].keys() & self.next[b].keys() if self.next[a][c] != self.next[b][c]]
        return True

    def _merge(self, a: int, b: int) -> None:
        """Fold the tree at b into a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.size[a] += self.size[b]
            self.count[a] += self.count[b]
            self.chars[a] += self.chars[b]
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def _merge_states(self) -> None:
        """Red states stay apart from each other; a blue one, a child of theirs, joins the first red state like it or turns red."""
        red, is_red = [0], {0}
        while blue := [(-self.size[q], p, c, q) for p in red for c, q in self.next[p].items() if q not in is_red]:
            _, parent, c, q = min(blue)
            for r in red:
                if self._alike(r, q):
                    self.next[parent][c] = r
                    self._merge(r, q)
                    break
            else:
                red.append(q)
                is_red.add(q)
        self.red, self.states = red, len(red)

    def _tabulate(self) -> None:
        """Next state by state and kind (unseen kinds lead back to the start), logarithms of probabilities by state and character, of ends."""
        n, place = self.states, {state: i for i, state in enumerate(self.red)}
        self.moves = np.zeros((n, len(KINDS)), np.int32)
        self.logs = np.zeros((n, len(_CHARACTERS)), np.float32)
        self.ends = np.zeros(n, np.float32)
        for state, source in enumerate(self.red):
            seen, chars = self.count[source], self.chars[source]
            whole = seen.total() + 0.05 * (len(KINDS) + 1)
            self.ends[state] = math.log((seen[END] + 0.05) / whole)
            for k, members in enumerate(KINDS):
                self.moves[state, k] = place[self.next[source].get(k, 0)]
                for c in members:  # of a kind, the characters seen here, and each as if seen a little
                    self.logs[state, _CODE[c]] = math.log((seen[k] + 0.05) / whole * (chars[c] + 1 / len(members)) / (seen[k] + 1))

    def scores(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each run codes[start : start + length]; runs in descending order of length."""
        state, total = np.zeros(len(starts), np.int32), np.zeros(len(starts))
        left = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), "right")
        for at, n in enumerate(left.tolist()):
            c = codes[starts[:n] + at]
            total[:n] += self.logs[state[:n], c]
            state[:n] = self.moves[state[:n], _KIND_OF_CODE[c]]
        return total + self.ends[state]

    def score(self, text: str) -> float:
        codes = np.array([_CODE[c] for c in text], np.uint8)
        return float(self.scores(codes, np.zeros(1, np.int64), np.array([len(text)]))[0])


_KIND_OF_CODE = np.array([_KIND[c] for c in _CHARACTERS], np.int32)
_CODE_OF_BYTE = np.full(128, 255, np.uint8)
_CODE_OF_BYTE[[ord(c) for c in _CHARACTERS]] = np.arange(len(_CHARACTERS))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, order of kind, end, value) of the fixed patterns' matches, in order; code points."""
    found = []
    low = text.lower()
    for order, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "assign" and not any(h in low for h in _ASSIGN_HINTS) or kind == "access" and "AKIA" not in text:
            continue
        found += [(m.start(), order, m.end(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found)


def candidates(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all characters of the texts, and text, start and end (in the text) of the runs of SHORTEST credential characters or more."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(points < 128, _CODE_OF_BYTE[np.minimum(points, 127)], 255).astype(np.uint8)
    inside = np.concatenate(([False], codes < 255, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= SHORTEST
    begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    text = np.searchsorted(begins, starts[long], "right") - 1
    return codes, text, starts[long], ends[long]


class Scanner:
    """Automata of all labels; learned: values by label, "ordinary" among them, that come to the generated ones."""

    def __init__(self, learned: dict[str, list[str]] | None = None) -> None:
        samples = labelled()
        for label, values in (learned or {}).items():
            if label == "ordinary" or len(values) >= LEAST_LEARNED:
                samples[label] = samples.get(label, []) + values
        made = {label: Automaton(values) for label, values in samples.items()}
        self.ordinary = made.pop("ordinary")
        self.formats = made

    def likely(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which runs of codes are more likely credentials of some format than ordinary."""
        parts = -(-(ends - starts) // PART)
        run = np.repeat(np.arange(len(starts)), parts)
        begin = starts[run] + (np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)) * PART
        lengths = np.minimum(PART, ends[run] - begin)
        order = np.argsort(-lengths, kind="stable")
        args = codes, begin[order], lengths[order]
        best = self.ordinary.scores(*args) * -1
        best += np.max([a.scores(*args) for a in self.formats.values()], axis=0)
        total = np.bincount(run[order], best, minlength=len(starts))
        return (total >= LEAST_TOTAL) & (total >= LEAST_RATIO * (ends - starts))

    def judge(self, text: str) -> bool:
        codes, _, starts, ends = candidates([text])
        return bool(self.likely(codes, starts, ends).any())


def learned(docs: DataFrame) -> dict[str, list[str]]:
    """Values by label: of base spans by kind, and of candidates outside them as ordinary; LEARNED a label, those with the least hashes.

    Each task reads all its documents and keeps as many; what they keep together is merged in the same way.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        least: dict[str, dict[str, int]] = {}

        def keep(label: str, values: set[str]) -> None:
            held = least.setdefault(label, {})
            held |= {v: int.from_bytes(hashlib.blake2b(v.encode(), digest_size=7).digest(), "big") for v in values if v not in held}
            if len(held) > LEARNED:
                least[label] = dict(sorted(held.items(), key=lambda x: x[1])[:LEARNED])

        for rows in batches(frames, 1_000_000):
            texts = [t or "" for t in rows["text"]]
            based = [base_spans(t) for t in texts]
            for order, (kind, *_) in enumerate(BASE):
                keep(kind, {v[:PART] for spans in based for _, k, _, v in spans if k == order})
            codes, text, starts, ends = candidates(texts)
            ends = np.minimum(ends, starts + PART)
            free = outside(text, starts, ends, based, texts)
            # a first choice by a cheap hash of ends and length, alike for equal values, so that few are made into strings
            mark = (codes[starts].astype(np.int64) * 31 + codes[ends - 1]) * 31 + codes[starts + SHORTEST // 2] * 7 + (ends - starts)
            chosen = np.flatnonzero(free & (mark % 16 == 0))
            begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
            keep("ordinary", {texts[k][a - begins[k] : b - begins[k]] for k, a, b in zip(text[chosen].tolist(), starts[chosen].tolist(), ends[chosen].tolist(), strict=True)})
        if least:
            yield pd.DataFrame([(k, v, h) for k, held in least.items() for v, h in held.items()], columns=["label", "value", "h"])

    found = docs.select("text").mapInPandas(run, "label string, value string, h long").distinct()
    found = cut(found)
    top = {}
    for label in [kind for kind, *_ in BASE] + ["ordinary"]:
        top[label] = [r["value"] for r in found.where(F.col("label") == label).orderBy("h", "value").limit(LEARNED).collect()]
    return top


def outside(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, based: list[list[tuple]], texts: list[str]) -> np.ndarray:
    """Which runs, in places of the joined texts, meet none of the texts' base spans. One pass over both, as both are in order."""
    begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]]).tolist()
    a = np.array([begins[k] + s[0] for k, spans in enumerate(based) for s in spans], np.int64)
    b = np.array([begins[k] + s[2] for k, spans in enumerate(based) for s in spans], np.int64)
    if not len(a):
        return np.ones(len(starts), bool)
    # the furthest end of the spans that begin before the run's end
    upto = np.concatenate(([-1], np.maximum.accumulate(b)))
    return upto[np.searchsorted(a, ends, "left")] <= starts


def query(docs: DataFrame) -> DataFrame:
    """A row a document, null text as empty: counts and digest of base spans, and all spans, the method's own under "likely".

    The automata come from bounded samples, SAMPLES generated values and LEARNED ones a label; base spans never depend on them, and all
    candidates of whole texts are scored, however long. Repeated rows and null ids come out like others; other columns play no part,
    whatever their names; an empty table gives an empty result.
    """
    scanner = Scanner(learned(docs))
    names = [kind for kind, *_ in BASE] + ["likely"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        said = lambda spans: ",".join([f"{names[k]}:{a}:{b}" for a, k, b in spans])
        for rows in batches(frames, 1_000_000):
            texts = [t or "" for t in rows["text"]]
            based = [base_spans(t) for t in texts]
            codes, text, starts, ends = candidates(texts)
            free = np.flatnonzero(outside(text, starts, ends, based, texts))
            hits = free[scanner.likely(codes, starts[free], ends[free])]
            begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
            likely: dict[int, list[tuple[int, int, int]]] = {}
            for k, a, b in zip(text[hits].tolist(), (starts - begins[text])[hits].tolist(), (ends - begins[text])[hits].tolist(), strict=True):
                likely.setdefault(k, []).append((a, len(BASE), b))
            out = []
            for i, (doc, found) in enumerate(zip(rows["doc_id"], based, strict=True)):
                base = [x[:3] for x in found]
                n = Counter(k for _, k, _ in base)
                own = likely.get(i, [])
                out.append((doc, n[0], n[1], n[2], hashlib.sha256(said(base).encode()).hexdigest(), said(sorted(base + own)), len(own)))
            yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_likely"])

    return by_document(docs.select("doc_id", "text"), run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_likely long")

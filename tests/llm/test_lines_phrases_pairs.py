"""Line dedup, collocations and alignment against brute force over awkward documents."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import align, collocations, linededup
from tessera.llm.bpe import byte_symbols
from tessera.llm.cuckoo import Cuckoo

WHITE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rnd = random.Random(11)
WORDS = ["".join(rnd.choices("abcdeäß", k=rnd.randint(1, 4))) for _ in range(12)]


def _line():
    return " ".join(rnd.choices(WORDS, k=rnd.randint(0, 14)))


SHARED = [_line() + " and more than twenty" for _ in range(8)] + ["short shared line", "a" * 20, "A" * 20, " \t" + "b" * 19 + " "]
TEXTS = [
    None, "", "\n", " \n\t\n", "one line of more than twenty signs", *["\n".join(rnd.choices(SHARED + ["", _line()], k=rnd.randint(1, 9))) for _ in range(60)],
    " ".join(rnd.choices(WORDS, k=6000)), "x" * 4000, "\n".join([SHARED[0]] * 300), "É" * 25 + "\n" + SHARED[1].upper(), "tab\tbetween  two   spaces , and ; marks!? yes\r\nno\x0bx\x0cy", "🙂 a▁b c", "<|endoftext|> <s> [UNK] <0x41>",
    "  leading and trailing  ", "　wide　space", "don't can't we'll 1234567 x́y", "a b\nc d\n\n\n e", "é   nbsp",
]
ROWS = [(i, t, [None, "en", "de", "und"][i % 4], "s") for i, t in enumerate(TEXTS)]
ROWS += [(200, TEXTS[9], "en", None), (201, TEXTS[9], "en", None), (None, TEXTS[10], "en", "s"), (None, TEXTS[10], "en", "s"), (None, SHARED[2], None, "s"), ROWS[12]]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    clash = {c: F.lit("7") for c in ("key", "h", "nameless", "drops", "rows", "n", "top", "block", "pair", "pairs", "word", "phrase", "f", "chunk", "part", "w")}
    return frame.withColumns(clash).repartition(3)


def _grouped(frame, *columns):
    return sorted(((r["doc_id"], *[r[c] for c in columns]) for r in frame.collect()), key=repr)


def test_cuckoo():
    r = np.random.default_rng(3)
    digests = r.integers(0, 2**64, (9000, 2), dtype=np.uint64)
    held = Cuckoo(1 << 10)  # 4096 places: it has to grow
    held.add(digests[:6000])
    held = Cuckoo(1 << 10, held.raw())
    assert held.has(digests[:6000]).all() and held.has(digests[6000:]).mean() < 0.02
    held.remove(digests[:5000])
    assert held.has(digests[5000:6000]).all() and held.has(digests[:5000]).mean() < 0.02
    held.remove(digests[5000:6000])
    assert not any(t.any() for t in held.tables)
    alike = np.repeat(digests[:1], 11, axis=0)  # the same mark and buckets: more than two buckets hold
    held.add(alike)
    held.remove(alike[1:])
    assert held.has(alike[:1]).all()
    assert Cuckoo(16).has(digests[:10]).sum() == 0 and Cuckoo(16).has(digests[:0]).size == 0


def _key(line):
    return line.strip(WHITE).translate(UPPER)


def _lines(rows, against=None):
    """Brute force: doc_id, n_lines, n_dropped, text."""
    name = lambda i, t: (1, i) if i is not None else (0, t)
    holders = defaultdict(set)
    for i, t, *_ in against or rows:
        for x in (t or "").split("\n"):
            holders[_key(x)].add(name(i, t))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        often = lambda k: len(k) >= 20 and len(holders[k]) >= 3
        keep = [x for x in lines if not often(_key(x)) or max(holders[_key(x)]) == name(i, t)]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def test_lines(docs):
    wanted = _lines(ROWS)
    assert sum(r[2] for r in wanted) > 100
    index = linededup.build(docs)
    assert _grouped(linededup.deduplicated(index, docs), "n_lines", "n_dropped", "text") == wanted
    digests = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in wanted]
    assert _grouped(linededup.query(docs), "n_lines", "n_dropped", "kept_sha256") == sorted(digests, key=repr)


def _state(index):
    return sorted(map(tuple, index.counts.collect())), sorted(map(tuple, index.refs.collect()))


def test_lines_come_and_go(spark, docs):
    """Documents that come later and go again leave the index as if they had never been there, filters included."""
    first, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1 OR doc_id IS NULL")
    small, whole = linededup.build(first), linededup.build(docs)
    both = linededup.insert(small, rest)
    assert _state(both) == _state(whole)
    assert _state(linededup.insert(both, rest)) == _state(whole)
    assert _grouped(linededup.deduplicated(both, docs), "n_lines", "n_dropped", "text") == _lines(ROWS)
    back = linededup.remove(both, rest)
    assert _state(back) == _state(small)
    keys = whole.counts.select("key")
    repeated = {bytes(r[0]) for r in back.counts.where("n >= 3").select("key").collect()}
    shown = {bytes(r[0]) for r in linededup.not_ruled_out(back, keys).collect()}
    assert repeated <= shown and len(shown - repeated) <= 2
    even = [r for r in ROWS if r[0] is not None and r[0] % 2 == 0]
    assert _grouped(linededup.deduplicated(back, first), "n_lines", "n_dropped", "text") == _lines(even)
    assert _state(linededup.remove(back, docs)) == ([], [])


def _phrases(rows, at_least, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= at_least}
    out = defaultdict(list)
    for p, a in often.items():
        lang, w = p[0], p[1:]
        inside = any(q[0] == lang and len(q) > len(p) and b >= a and any(q[i : i + len(w)] == w for i in range(1, len(q) - len(w) + 1)) for q, b in often.items())
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, r) in enumerate(sorted(found)[:top]))


@pytest.mark.parametrize(("at_least", "part"), [(3, 4), (100, 1 << 15), (8, 1 << 15)])
def test_phrases(docs, monkeypatch, at_least, part):
    """With parts of a few occurrences every pivot is split; ties and repeats of one word are in the texts."""
    monkeypatch.setattr(collocations, "PART", part)
    got = sorted(tuple(r) for r in collocations.collocations(docs, at_least, top=40).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == _phrases(ROWS, at_least, 40)
    assert at_least > 50 or {r[2].count(" ") for r in got} == {1, 2, 3, 4}


def test_packed():
    cells = np.zeros(collocations.CHUNK, np.uint32)
    cells[[0, 5, 77, 1000, 65535]] = [1, 254, 255, 2**31, 2**32 - 1]
    assert (collocations.unpacked(collocations.packed(cells)) == cells).all()


def test_extents():
    rarity, pairs, triples = np.array([5, 3, 3, 9, 1, 7], np.uint64), np.ones(5, bool), np.ones(4, bool)
    left, right = collocations.extents(rarity, pairs, triples, 4)
    assert left.tolist() == [0, 1, 0, 0, 4, 0] and right.tolist() == [0, 2, 1, 0, 1, 0]
    triples[1] = False  # 3 3 9
    left, right = collocations.extents(rarity, pairs, triples, 4)
    assert left.tolist() == [0, 1, 0, 0, 2, 0] and right.tolist() == [0, 1, 1, 0, 1, 0]
    assert collocations.extents(rarity[:1], pairs[:0], triples[:0], 4)[0].tolist() == [0]


def _aligned(rows):
    a_side = Tokenizer.from_file(public_tokenizers.path(align.A_FILE))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.B_FILE))
    byte_of = {s: i for i, s in enumerate(byte_symbols())}
    each, held = [], Counter()
    for i, text, *_ in rows:
        a = a_side.encode(" " + (text or ""), add_special_tokens=False)
        b = b_side.encode(text or "")
        x = [bytes(byte_of[c] for c in t) for t in a.tokens]
        y = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b_side.id_to_piece, b)]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(x) != raw or b"".join(y) != raw:
            each.append((i, 0, 0, [], []))
            continue
        spans = lambda t: [(sum(map(len, t[:k])), sum(map(len, t[: k + 1]))) for k in range(len(t))]
        if len(x) > 2000:  # the sums above would take too long
            ends = lambda t: np.cumsum([len(z) for z in t])
            spans = lambda t, ends=ends: list(zip((ends(t) - [len(z) for z in t]).tolist(), ends(t).tolist(), strict=True))
        p, q = spans(x), spans(y)
        links, k = [], 0
        for u, (s, e) in enumerate(p):
            while q[k][1] <= s:
                k += 1
            v = k
            while v < len(q) and q[v][0] < e:
                links.append((a.ids[u], b[v]))
                v += 1
        cuts = sorted({e for _, e in p} & {e for _, e in q})
        parts, u, v = [], 0, 0
        for c in cuts:
            s, t = u, v
            while u < len(p) and p[u][1] <= c:
                u += 1
            while v < len(q) and q[v][1] <= c:
                v += 1
            parts.append(",".join(map(str, a.ids[s:u])) + "|" + ",".join(map(str, b[t:v])))
        held.update(set(links))
        each.append((i, len(x), len(y), parts, links))
    best = Counter()
    for (x, _), k in held.items():
        best[x] = max(best[x], k)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return sorted(((i, n, m, len(g), len(ls), sum(held[p] == best[p[0]] for p in ls), sum(held[p] for p in ls), digest(g)) for i, n, m, g, ls in each), key=repr)


@pytest.mark.parametrize("memory", [(120_000, 4_000_000), (7, 300)])
def test_alignment(docs, monkeypatch, memory):
    """With hardly any memory and many blocks too. Texts with U+2581 have no tokens."""
    monkeypatch.setattr(align, "REMEMBERED", memory[0])
    monkeypatch.setattr(align, "BLOCK", memory[1])
    wanted = _aligned(ROWS)
    assert sum(r[1] > 0 for r in wanted) > 60 and sum(r[3] < r[1] for r in wanted) > 10
    assert _grouped(align.query(docs), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256") == wanted


def test_empty(docs):
    for module in (linededup, collocations, align):
        assert module.query(docs.where("false")).collect() == []


def test_pivot_is_shuffled_once(spark):
    """Fragments are dealt by the pivot within them; a column for it made the shuffle outgrow its budget of disk."""
    docs = spark.createDataFrame([("red apple pie, red apple", "en"), ("red apple pie", "en"), (None, None)], "text string, lang string")
    known = spark.sparkContext.broadcast(collocations.tables(collocations.first_pass(docs), 2))
    rows = collocations.fragments(docs, known, 2, 5)
    assert rows.columns == ["lang", "part", "place", "fragment", "n"]
    phrases, totals = collocations.frequent_phrases(docs, 2, 5)
    found = {r["phrase"]: r["f"] for r in phrases.collect()}
    assert found == {"red": 3, "apple": 3, "pie": 2, "red apple": 3, "apple pie": 2, "red apple pie": 2}
    assert [tuple(r) for r in totals.collect()] == [("en", 8)]

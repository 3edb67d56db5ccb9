"""corpus_pipeline.run against a brute-force version of all its stages, over documents with nulls, copies and rows without ids."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import pytest
import public_tokenizers
import tiktoken

from tessera.llm import bpe, pii

rnd = random.Random(11)
VOCABULARY = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 8))) for _ in range(300)]


def prose(n):
    return " ".join(rnd.choices(VOCABULARY, k=n))


def _rows():
    base = [prose(rnd.randint(60, 200)) for _ in range(30)]
    texts = [*base, *base[:6]]
    for t in base[6:12]:
        ws = t.split()
        ws[rnd.randrange(len(ws))] = "changed"
        texts.append(" ".join(ws))
    texts += [None, "", "too short", "same old words " * 60, "### $$$ " * 60, prose(90).upper(), prose(80) + " !" * 60, base[14] + " call +1 415 555 2671 on 2001-02-03"]
    rows = [(i, t, "en", None if i % 9 == 4 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, base[20], "en", "src1", 1), (None, prose(100), "en", None, 1), (None, prose(70), "en", "src9", 1), rows[2], rows[25], (7, prose(60), None, "src0", 2)]
    return rows


def _passes(text):
    ws, text = (text or "").split(), text or ""
    grams = list(zip(ws, ws[1:], ws[2:], strict=False))
    often = Counter(grams)
    repeated = len({p for k, g in enumerate(grams) if often[g] > 1 for p in (k, k + 1, k + 2)})
    lines = [x for x in text.split("\n") if x.strip()]
    n, chars = len(ws), sum(map(len, ws))
    fails = [
        n < 50, 100 * repeated > 50 * n, 10 * sum(c in "#*$%&|<>" for c in text) > n, 2 * (len(lines) - len(set(lines))) > len(lines),
        2 * sum("A" <= c <= "Z" for c in text) > chars, 4 * text.count("!") > n, chars < 2 * n, chars > 15 * n,
    ]
    return not any(fails)


def _deduplicated(rows):
    sets = []
    for r in rows:
        ws = r[1].lower().split()
        sets.append({tuple(ws[k : k + 5]) for k in range(len(ws) - 4)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def _mixed(rows):
    size = lambda r: len(r[1].split())
    totals = Counter()
    for r in rows:
        totals[r[3]] += size(r)
    order = sorted(s for s in totals if s is not None) + [None] * (None in totals)
    weight, full = {s: k % 3 + 1 for k, s in enumerate(order)}, set()
    while True:
        left = sum(totals.values()) - sum(3 * totals[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order if s not in full}
        over = {s for s in share if share[s] > 3 * totals[s]}
        if not over:
            break
        full |= over
    out = []
    for s in order:
        target = share.get(s, 3 * totals[s])
        whole = min(3, int(target // totals[s]))
        budget, upto, open_ = target - whole * totals[s], 0, True
        place = lambda r: hashlib.md5(f"{'' if r[0] is None else r[0]}:{r[1]}".encode()).hexdigest()[:15]
        for r in sorted((r for r in rows if r[3] == s), key=place):
            below, upto = upto, upto + size(r)
            more = open_ and whole < 3 and (upto <= budget or upto - budget < budget - below)
            open_ = open_ and upto <= budget
            out += [r] * (whole + more)
    return out


def test_pipeline(spark, tmp_path):
    rows = _rows()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    kept = _deduplicated([r for r in rows if _passes(r[1])])
    assert 20 < len(kept) < len(rows) - 12
    names = pii.Pseudonyms(pii.KEY)
    want = []
    for doc, text, *_ in _mixed([(r[0], names.replace(r[1])[0], *r[2:]) for r in kept]):
        ids = library.encode_ordinary(text)
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert Counter(got) == Counter(want)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_columns(spark, tmp_path, k):
    docs = spark.createDataFrame(_rows(), "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.STAGES[k][1](spark, docs, str(tmp_path)).columns == docs.columns

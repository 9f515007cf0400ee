import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import lm_trie
from tenderloom.llm.queries import op10_lm_scoring

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = {"WORD_BYTES": 200, "GRAM_BYTES": 100, "BLOCK": 500}


def brute(rows):
    """(n_tokens, n_known, train_tokens, base_score, score) of rows (id, text, train), by dictionaries."""
    seqs = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t, _ in rows]
    one, two, three = Counter(), Counter(), Counter()
    follows = Counter()
    for s, (_, _, train) in zip(seqs, rows, strict=True):
        if train:
            one.update(s)
            padded = ["<s>", "<s>", *s]
            two.update(zip(padded[1:], padded[2:], strict=False))
            three.update(zip(padded, padded[1:], padded[2:], strict=False))
            follows["<s>"] += 1
            follows["<s>", "<s>"] += 1
    n, v, a, b = sum(one.values()), len(one), lm_trie.PRIOR2, lm_trie.PRIOR3
    out = []
    for s in seqs:
        padded, score, base = ["<s>", "<s>", *s], 0.0, 0.0
        for x, y, w in zip(padded, padded[1:], padded[2:], strict=False):
            p = (one[w] + 1) / (n + v + 1)
            cy = follows["<s>"] if y == "<s>" else one[y]
            cxy = follows["<s>", "<s>"] if (x, y) == ("<s>", "<s>") else two[x, y]
            score += math.log10((three[x, y, w] + b * (two[y, w] + a * p) / (cy + a)) / (cxy + b))
            base += math.log10(p)
        out.append((len(s), sum(one[w] > 0 for w in s), n, base, score))
    return out


def same(got, rows):
    key = lambda x: (str(x[0]), x[1], round(x[4], 3))
    have = sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got], key=key)
    want = sorted([(i, *b) for (i, _, _), b in zip(rows, brute(rows), strict=True)], key=key)
    assert len(have) == len(want)
    for h, w in zip(have, want, strict=True):
        assert h[:4] == w[:4] and h[4] == pytest.approx(w[4], rel=1e-9) and h[5] == pytest.approx(w[5], rel=1e-4, abs=1e-3)


@pytest.mark.parametrize("small", [False, True])
def test_scores(spark, docs, monkeypatch, small):
    for name, value in SMALL.items() if small else ():
        monkeypatch.setattr(lm_trie, name, value)
    rows = [(r["doc_id"], r["text"], (r["doc_id"] or 0) % 3 != 1) for r in docs.collect()] + [(100 + i, "red green blue " * (i + 1), i % 2 == 0) for i in range(9)] + [(100, "red green blue ", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(3, "doc_id")
    same(lm_trie.score(df, F.col("learn")).collect(), rows)


@pytest.mark.parametrize("frequent", [1, lm_trie.FREQUENT])
def test_hot_words_score_as_others(spark, monkeypatch, frequent):
    monkeypatch.setattr(lm_trie, "FREQUENT", frequent)
    rows = [(i, "the cat the dog the cat " * 100 + f"w{i % 7}", True) for i in range(40)] + [(99, "cat w1 w2 the unheard the", False)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1)
    same(lm_trie.score(df, F.col("doc_id") != 99).collect(), rows)


def test_query_is_the_model_by_dictionaries(spark):
    got = op10_lm_scoring(spark, DATA).collect()
    held = {r["doc_id"]: r["held_out"] for r in got}
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    same(got, [(r["doc_id"], r["text"], not held[r["doc_id"]]) for r in texts])
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_no_rows_and_nothing_to_learn(spark, docs, none):
    assert lm_trie.score(none, F.lit(True)).count() == 0
    got = lm_trie.score(docs, F.lit(False)).collect()
    assert len(got) == docs.count() and all(r["base_score"] == 0 and r["train_tokens"] == 0 and r["score"] == pytest.approx(0, abs=1e-6) for r in got)


@pytest.mark.parametrize("top", [1, 40, 2**30, 2**50])
def test_elias_fano(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 2, 700):
        values = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = lm_trie.EliasFano.of(values)
        if n:
            assert e.get(np.arange(n)).tolist() == values.tolist()
        want = np.concatenate([values, rng.integers(0, top + 5, 50, dtype=np.uint64)])
        low, high = rng.integers(0, n + 1, (2, len(want)))
        low, high = np.minimum(low, high), np.maximum(low, high)
        place, found = e.successor(low, high, want)
        for a, b, w, p, f in zip(low.tolist(), high.tolist(), want.tolist(), place.tolist(), found.tolist(), strict=True):
            right = a + int(np.searchsorted(values[a:b], w))
            assert p == right and f == (right < b and values[right] == w)


def test_trie_finds_what_it_holds():
    rng = np.random.default_rng(5)
    grams = np.unique(rng.integers(0, 30, (3000, 3)), axis=0)
    ids = np.sort(rng.choice(10**6, 30, replace=False)).astype(np.uint64)
    both = grams[:, 0] << 32 | grams[:, 1]
    trie = lm_trie._trained(ids, np.full(30, 9.0), np.full(30, 0.1), both, ids[grams[:, 2]], np.ones(len(grams)))
    held = set(map(tuple, grams.tolist()))
    asked = rng.integers(0, 30, (5000, 3))
    pair, triple = trie.find(ids[asked[:, 0]], ids[asked[:, 1]], ids[asked[:, 2]])
    assert (triple >= 0).tolist() == [tuple(a) in held for a in asked.tolist()]
    assert (pair >= 0).tolist() == [(a[0], a[1]) in {g[:2] for g in held} for a in asked.tolist()]
    assert len(set(triple[triple >= 0].tolist())) == len({tuple(a) for a in asked.tolist()} & held)

import math
import random
import re

import numpy as np
import pytest

from tenderloom.llm import near_dedup
from tenderloom.llm.queries import op9_minhash_near_dedup

DATA = "/root/testdata/sf0.001"

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    shingles = [(i, sets(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in shingles:
        for b, y in shingles:
            if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return sorted((i, len(x), find(i)) for i, x in shingles)


def corpus(seed, groups, copies, words=60):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 9))):
                text[rng.randrange(words)] = f"v{rng.randint(0, 10**6)}"
            rows.append((len(rows) * 3 + g % 2, " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_same_groups_as_all_pairs(spark, k, percent):
    rows = corpus(k, 12, 14)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(df, k, percent).collect())
    assert got == brute(rows, k, percent)


def test_one_large_group_in_cells(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CELL", 16)
    rows = corpus(9, 1, 150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(df, 3, 85).collect())
    assert got == brute(rows, 3, 85)


def test_small_texts_nulls_and_kept_rows(spark, none):
    rows = [(4, "A b"), (2, "a  B"), (9, None), (8, ""), (7, "a"), (6, " \t"), (3, "x y z"), (1, "x y z w")]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, sig string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(df, 3, 85).collect()}
    assert got == {4: (1, 2), 2: (1, 2), 9: (0, 9), 8: (0, 8), 7: (1, 7), 6: (0, 6), 3: (1, 3), 1: (2, 1)}
    assert near_dedup.near_groups(none, 3, 85).count() == 0
    twice = df.unionByName(df.filter("doc_id = 2"))
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(twice, 3, 85).collect()) == [1, 2, 3, 6, 7, 8, 9]


def test_pigeonhole_covers_the_threshold():
    for percent in (80, 85):
        assert near_dedup.limit_of(percent) <= near_dedup.ERRORS * near_dedup.CHUNKS + near_dedup.CHUNKS - 1


def chained(n):
    """A group in which each text is a copy of another with one to five changed words."""
    rng, rows = random.Random(4), []
    base = [f"w{i}" for i in range(80)]
    for i in range(n):
        text = list(rng.choice(rows)[1].split()) if rows and i % 3 else list(base)
        for _ in range(rng.randint(1, 5)):
            text[rng.randrange(80)] = f"v{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize(("cell", "few_rows", "few_links"), [(16, 4, 3), (4096, 64, 15_000)])
def test_group_of_many_components(spark, monkeypatch, cell, few_rows, few_links):
    """Most texts are linked with some others, not with the smallest."""
    monkeypatch.setattr(near_dedup, "CELL", cell)
    monkeypatch.setattr(near_dedup, "FEW_ROWS", few_rows)
    monkeypatch.setattr(near_dedup, "FEW_LINKS", few_links)
    rows = chained(120)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(df, 3, 85).collect())
    assert got == brute(rows, 3, 85)


@pytest.mark.parametrize("n", [500, 2000])
def test_confirmed_pairs_are_near_linear(spark, monkeypatch, n):
    """Beyond the two comparisons of every class, no more than a tenth of n log n pairs are given out and confirmed."""
    rounds, across = [], near_dedup.across
    monkeypatch.setattr(near_dedup, "across", lambda *a: rounds.append(across(*a)) or rounds[-1])
    near_dedup.near_groups(spark.createDataFrame(chained(n), "doc_id long, text string").repartition(8), 3, 85)
    assert 0 < sum(rounds[0][1]) < 0.1 * n * math.log2(n)


def test_odd_sketches_never_say_more_than_the_sets():
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randint(0, 30 if i % 2 else 3000)}" for _ in range(rng.choice([3, 40, 400, 3000]))) for i in range(40)]
    hashes, bounds = near_dedup.shingle_sets([t.encode() for t in texts], 3)
    odd = near_dedup.odd_sketches(hashes, bounds)
    held = [set(hashes[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    p, q = np.triu_indices(len(texts))
    got = near_dedup.odd_distances(odd, p, q)
    assert all(d <= len(held[a] ^ held[b]) and (a != b or d == 0) for a, b, d in zip(p, q, got.tolist()))
    assert sum(d > 0.6 * len(held[a] ^ held[b]) for a, b, d in zip(p, q, got.tolist()) if a != b and len(held[a]) < 500 > len(held[b])) > 100


@pytest.mark.parametrize("n_forests", [1, 2, None])
def test_later_rounds_give_what_is_left(spark, monkeypatch, n_forests):
    """Forests of pairs that fail do not hide the pairs behind them."""
    monkeypatch.setattr(near_dedup, "FORESTS", (n_forests,) * 2 if n_forests else ())
    monkeypatch.setattr(near_dedup, "odd_distances", lambda odd, p, q: np.zeros(len(p), np.int64))  # nothing is refuted early
    rows = chained(90)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_groups(df, 3, 85).collect())
    assert got == brute(rows, 3, 85)


def test_rows_are_told_apart_by_id_and_text(spark, docs):
    rows = [(1, "a b c d e f"), (7, "a b c d e f"), (7, "another text of words"), (None, "no id has this one"), (None, "a b c d e f"), (9, "no id has this one"), (None, None), (None, "only here it is said")]
    df = spark.createDataFrame([(*r, "s", 3) for r in rows], "doc_id long, text string, spans string, component int")
    kept = sorted(((r["doc_id"], r["text"]) for r in near_dedup.keep_one(df, 3, 85).collect()), key=str)
    assert kept == sorted([(1, "a b c d e f"), (7, "another text of words"), (9, "no id has this one"), (None, None), (None, "only here it is said")], key=str)
    assert near_dedup.keep_one(docs).columns == docs.columns
    assert near_dedup.near_groups(docs).count() == docs.count()


def test_query_is_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = op9_minhash_near_dedup(spark, DATA).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)

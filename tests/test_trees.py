"""The tree ranker against plain loops: training, scores, Shapley values."""

import math
import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.operators import trees
from tenderloom.operators.scratch import Scratch

FEATURES = ("a", "b", "c")


def table(seed=1, groups=40):
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        for _ in range(r.randrange(2, 9)):
            a, b, c = r.random(), r.choice([0.0, 1.0, 2.0, None]), r.choice([r.random(), math.nan])
            rows.append((g if g else None, a, b, c, float(a + (b or 0) / 2 + r.gauss(0, 0.2) > 1.2)))
    return rows


def plain_train(rows, cuts, n_trees, depth, rate, l2):
    """The same boosting, a row at a time, with sums in floating point."""
    groups = {}
    for g, *x, y in rows:
        groups.setdefault(g, []).append(([-math.inf if v is None or math.isnan(v) else v for v in x], y))
    groups = [v for g, v in groups.items() if g is not None and any(y for _, y in v)]
    score = [[0.0] * len(v) for v in groups]
    out = []
    for _ in range(n_trees):
        grads = []
        for v, s in zip(groups, score):
            e = [math.exp(x) for x in s]
            ys = sum(y for _, y in v)
            grads += [(x, y / ys - w / sum(e), w / sum(e) * (1 - w / sum(e))) for (x, y), w in zip(v, e)]
        splits = []
        for _ in range(depth):
            best = None
            for f in range(len(cuts)):
                for border in cuts[f]:
                    sides = {}
                    for x, g, h in grads:
                        key = tuple(x[i] > t for i, t in [*splits, (f, border)])
                        sg, sh = sides.get(key, (0.0, 0.0))
                        sides[key] = sg + g, sh + h
                    gain = round(sum(g * g / (h + l2) for g, h in sides.values()), 7)
                    if best is None or gain > best[0]:
                        best = gain, f, border
            splits.append(best[1:])
        leaf = lambda x: sum((x[f] > t) << k for k, (f, t) in enumerate(splits))
        g, h = np.zeros(1 << depth), np.zeros(1 << depth)
        for x, gg, hh in grads:
            g[leaf(x)] += gg
            h[leaf(x)] += hh
        values = rate * g / (h + l2)
        score = [[s + values[leaf(x)] for (x, _), s in zip(v, ss)] for v, ss in zip(groups, score)]
        out.append((splits, values))
    return out


@pytest.fixture(scope="module")
def model(spark):
    df = spark.createDataFrame(table(), "g int, a double, b double, c double, y double").repartition(3)
    return df, trees.train(df, "g", "y", FEATURES, Scratch(spark, "t").write, trees=10, depth=3, rate=0.3, l2=1.0, bins=8)


def test_training_against_loops(spark, model):
    df, m = model
    cuts = trees.borders(df, FEATURES, 8)
    want = plain_train(table(), [c.tolist() for c in cuts], 10, 3, 0.3, 1.0)
    assert len(m.leaves) == 10  # more than KEEP_EVERY, so scores were kept once
    for t, (splits, values) in enumerate(want):
        assert [(int(f), float(b)) for f, b in zip(m.split_feature[t], m.split_border[t])] == splits
        assert np.allclose(m.leaves[t], values, atol=1e-5)
    assert m.losses[-1][0] < m.losses[0][0]
    again = trees.train(df.repartition(7), "g", "y", FEATURES, Scratch(spark, "t").write, trees=10, depth=3, rate=0.3, l2=1.0, bins=8)
    assert (again.leaves == m.leaves).all() and (again.split_border == m.split_border).all()


def test_stops_at_the_lowest_loss(spark):
    rows = [(g, a, b, c, y if g is None or g % 2 else 1.0 - y) for g, a, b, c, y in table(3)]  # what is kept aside says the contrary
    df = spark.createDataFrame(rows, "g int, a double, b double, c double, y double")
    m = trees.train(df, "g", "y", FEATURES, Scratch(spark, "t").write, trees=10, depth=2, rate=0.3, l2=1.0, bins=8, aside=F.col("g") % 2 == 0, patience=2)
    assert len(m.leaves) == int(np.argmin([v for _, v in m.losses])) and len(m.losses) < 11


def walk(m, t, x, known):
    """The expected value of a tree for a row of which only ``known`` features are told: a walk down both ways."""
    depth = m.split_feature.shape[1]

    def down(level, prefix):
        if level == depth:
            return m.leaves[t][prefix]
        f, border = m.split_feature[t][level], m.split_border[t][level]
        if f in known:
            return down(level + 1, prefix | int(x[f] > border) << level)
        cover = [sum(int(c) for i, c in enumerate(m.cover[t]) if i & ((2 << level) - 1) == prefix | bit << level) for bit in (0, 1)]
        if not sum(cover):
            cover = [1, 1]
        return sum(c / sum(cover) * down(level + 1, prefix | bit << level) for bit, c in enumerate(cover) if c)

    return down(0, 0)


def test_shares_are_shapley_values(model):
    df, m = model
    got = trees.score(df, m, shares="shares").collect()
    assert len(got) == len(table())
    for r in got[:25]:
        x = [-math.inf if r[f] is None or math.isnan(r[f]) else r[f] for f in FEATURES]
        whole = sum(walk(m, t, x, {0, 1, 2}) for t in range(len(m.leaves)))
        assert r["tree_score"] == pytest.approx(whole)
        want = [0.0] * 3
        for order in permutations(range(3)):
            for i, f in enumerate(order):
                want[f] += sum(walk(m, t, x, {*order[: i + 1]}) - walk(m, t, x, {*order[:i]}) for t in range(len(m.leaves))) / 6
        assert r["shares"] == pytest.approx(want)
        assert sum(r["shares"]) == pytest.approx(r["tree_score"] - m.bias())


def test_reasons(spark):
    groups = {"x": (("a",), "true"), "y": (("b", "c"), "k > 0"), "z": (("c",), "true")}
    df = spark.createDataFrame([(1, [0.2, 0.1, 0.2]), (0, [0.2, 0.5, 0.2]), (None, [-1.0, 1.0, 1e-7])], "k int, s array<double>")
    assert [r[0] for r in df.select(trees.reasons("s", FEATURES, groups, 2)).collect()] == [["y", "x"], ["x", "z"], []]


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, 1.0, None, 2.0, 0.0), (None, 1.0, 1.0, 1.0, 1.0)], "g int, a double, b double, c double, y double")
    for rows in (df, df.limit(0)):
        m = trees.train(rows, "g", "y", FEATURES, Scratch(spark, "t").write, trees=3, depth=2)
        assert m.leaves.shape == (0, 4)
        assert [r["tree_score"] for r in trees.score(rows, m).collect()] == [0.0] * rows.count()

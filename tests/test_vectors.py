"""Nearest vectors against all pairs, many queries at once, and the recall of the index of cells."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.operators import vectors

DATA = "/root/testdata/sf0.01"


def plain(rows, queries, most, by=None):
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    ok = lambda v: v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    out = set()
    for q, v in queries:
        if not ok(v):
            continue
        near = {}
        for k, w, g in rows:
            if ok(w) and len(w) == len(v):
                near.setdefault(g if by else 0, []).append((-round(float(unit(v) @ unit(w)), 9), str(k), k))
        out |= {(q, k) for found in near.values() for _, _, k in sorted(found)[:most]}
    return out


def table():
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=4).tolist(), ["a", "b", None][i % 3]) for i in range(60)]
    rows += [(100, None, "a"), (101, [], "a"), (102, [0.0] * 4, "b"), (103, [math.nan, 1.0, 0.0, 0.0], "b"), (104, [1.0, None, 0.0, 0.0], "a"), (105, [1e-200, 2e-200, 0.0, 0.0], "a"), (106, [1.0, 2.0], "a"), (107, [1e200, 0.0, 1e200, 1e199], None)]
    return rows


@pytest.mark.parametrize(("part", "block", "by"), [(65_536, 2_000, None), (7, 5, None), (9, 4, "g")])
def test_exact(spark, monkeypatch, part, block, by):
    monkeypatch.setattr(vectors, "PART", part)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    rows = table()
    v = spark.createDataFrame(rows, "k long, v array<double>, g string").repartition(4)
    q = v.select(F.col("k").alias("query_id"), F.col("v").alias("vector"))
    got = [(r["query_id"], r["k"]) for r in vectors.nearest(v, q, "k", "v", 3, by=by).collect()]
    fixed = [(k, [x * 1e200 for x in w] if k == 105 else [x / 1e200 for x in w] if k == 107 else w, g) for k, w, g in rows]
    assert len(set(got)) == len(got) and set(got) == plain(fixed, [(k, w) for k, w, _ in fixed], 3, by)


def test_plan_does_not_follow_the_queries(spark, capsys):
    v = spark.createDataFrame(table(), "k long, v array<double>, g string")
    q = v.select(F.col("k").alias("query_id"), F.col("v").alias("vector"))
    sizes = []
    for n in (1, 40):
        vectors.nearest(v, q.limit(n), "k", "v", 3).explain()
        sizes.append(capsys.readouterr().out.count("\n"))
    assert sizes[0] == sizes[1]
    assert vectors.nearest(v, q.limit(0), "k", "v", 3).count() == 0 == vectors.nearest(v.limit(0), q, "k", "v", 3).count()


def test_recall_of_cells(spark):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    q = v.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = vectors.CellIndex(v, "vec_id", "embedding", cells=32)
    assert index.rows.count() == v.count()
    pairs = lambda df: {(r["query_id"], r["vec_id"]) for r in df.collect()}
    exact = pairs(vectors.nearest(v, q, "vec_id", "embedding", 5))
    assert len(pairs(index.nearest(q, 5, probes=20)) & exact) / len(exact) >= 0.9
    assert pairs(index.nearest(q, 5, probes=32)) == exact


def test_recall_where_vectors_lie_in_groups(spark):
    r = np.random.default_rng(9)
    middle = r.normal(size=(30, 32))
    rows = [(i, (middle[i % 30] + 0.3 * r.normal(size=32)).tolist()) for i in range(900)]
    v = spark.createDataFrame(rows, "k long, v array<double>").repartition(4)
    q = v.filter("k % 20 = 0").select(F.col("k").alias("query_id"), F.col("v").alias("vector"))
    pairs = lambda df: {(x["query_id"], x["k"]) for x in df.collect()}
    exact = pairs(vectors.nearest(v, q, "k", "v", 5))
    assert len(pairs(vectors.CellIndex(v, "k", "v", cells=30).nearest(q, 5, probes=3)) & exact) / len(exact) >= 0.95


def test_cells_split_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PART", 5)
    rows = table()
    v = spark.createDataFrame(rows, "k long, v array<double>, g string")
    q = v.select(F.col("k").alias("query_id"), F.col("v").alias("vector"))
    index = vectors.CellIndex(v, "k", "v", cells=3)
    got = {(r["query_id"], r["k"]) for r in index.nearest(q, 3, probes=3).collect()}
    assert got == {(r["query_id"], r["k"]) for r in vectors.nearest(v, q, "k", "v", 3).collect() if 106 not in (r["query_id"], r["k"])}
    empty = vectors.CellIndex(v.limit(0), "k", "v", cells=3)
    assert empty.nearest(q, 3).count() == 0


def test_few_products_are_held_at_once():
    import tracemalloc

    import pyarrow as pa

    rng, n = np.random.default_rng(3), 1 << 16
    table = lambda key, v: pa.table({key: np.arange(len(v)), "vector": pa.FixedSizeListArray.from_arrays(v.ravel(), v.shape[1]).cast(pa.list_(pa.float64()))})
    stored, asked = rng.normal(size=(n, 4)), rng.normal(size=(300, 4))
    tracemalloc.start()
    got = vectors._best(table("k", stored), table("query_id", asked), "k", None, 3, 9).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and len(got) == 900
    near = (asked / np.linalg.norm(asked, axis=1, keepdims=True)) @ (stored / np.linalg.norm(stored, axis=1, keepdims=True)).T
    assert (got["k"].to_numpy().reshape(300, 3) == np.argsort(-near, axis=1)[:, :3]).all()

import hashlib

import numpy as np

from tenderloom.llm import fingerprint
from tenderloom.llm.queries import op4_fingerprints

DATA = "/root/testdata/sf0.001"


def test_differences_are_recovered_at_any_size():
    rng = np.random.default_rng(1)
    sets = []
    for common, a, b in ((0, 0, 0), (5, 1, 0), (40, 3, 9), (10, 200, 300), (0, 0, 7)):
        x = np.unique(rng.integers(1, 2**63, common + a + b, dtype=np.uint64))
        sets.append((x[: common + a], np.concatenate([x[:common], x[common + a :]])))
    got = fingerprint.recover([s for s, _ in sets], [s for _, s in sets])
    for (x, y), only in zip(sets, got, strict=True):
        assert only == {(k, 1) for k in set(x.tolist()) - set(y.tolist())} | {(k, -1) for k in set(y.tolist()) - set(x.tolist())}


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        changed = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        sets = [set(fingerprint.digests(x).tolist()) for x in (t, changed, n)]
        like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        out.append((i, len(t), changed, round(like(sets[0], sets[1]), 9), round(like(sets[0], sets[2]), 9)))
    return sorted(out, key=str)


def test_edits_and_likeness(spark, docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = fingerprint.fingerprint(docs).collect()
    assert sorted([(r["doc_id"], r["n_chars"], r["edited"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got], key=str) == brute(rows)
    prints = {}
    for r in got:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[1] <= prints[7] and prints[2] == prints[3]
    assert fingerprint.fingerprint(none).count() == 0
    assert fingerprint.fingerprint(docs.limit(1)).first()["near_next"] == 1.0


def test_one_row_follows_another_across_ranges(spark):
    rows = [(i * i, f"text {i}. " * (i % 7 + 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprint.fingerprint(df).collect()
    assert sorted([(r["doc_id"], r["n_chars"], r["edited"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got], key=str) == brute(rows)


def test_outlying_and_equal_ids_do_not_crowd_a_range(spark):
    rows = [(i, f"text {i}. and more") for i in range(400)] + [(2**50, "far away."), (-(2**50), "far down.")] + [(77, f"same id {i}.") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = fingerprint.fingerprint(df).collect()
    assert sorted([(r["doc_id"], r["n_chars"], r["edited"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got], key=str) == brute(rows)
    sizes = [r["count"] for r in fingerprint.in_order(df, parts=8).groupBy("part").count().collect()]
    assert len(sizes) >= 7 and max(sizes) <= 2 * len(rows) / 8


def test_peeling_goes_on_until_all_is_recovered(monkeypatch):
    monkeypatch.setattr(fingerprint, "CELLS", 3)
    rng = np.random.default_rng(2)
    x = [np.unique(rng.integers(1, 2**63, 60, dtype=np.uint64)) for _ in range(50)]
    for (a, b), only in zip(zip(x[::2], x[1::2], strict=True), fingerprint.recover(x[::2], x[1::2], 3), strict=True):
        assert only == {(k, 1) for k in a.tolist()} | {(k, -1) for k in b.tolist()}


def test_query_is_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = op4_fingerprints(spark, DATA).collect()
    want = [(i, n, hashlib.sha256(c.encode()).hexdigest(), a, b) for i, n, c, a, b in brute(rows)]
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got], key=str) == sorted(want, key=str)


def test_tables_of_one_id_and_of_none(spark):
    for ids in ([None] * 50, [7] * 20, [None] * 30 + [5], [-3, None]):
        rows = [(i, f"text {n}. and more") for n, i in enumerate(ids)]
        got = fingerprint.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted([(r["doc_id"], r["n_chars"], r["edited"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got], key=str) == brute(rows)

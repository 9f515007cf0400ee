import hashlib
import math
import random

import numpy as np
import pytest

from tenderloom.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, codes int, __group string"


def plain(rows, parts, entries, rounds):
    """Lloyd's iteration in Python numbers: {(id, components): (codes, error)} and the codebooks."""
    kept = [(i, [math.floor(4096 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = -(-max(len(x) for _, x in kept) // parts)
    kept = [(i, x, x + [0] * (width * parts - len(x))) for i, x in kept]
    first = [x for _, _, x in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]]
    books = [[x[p * width : (p + 1) * width] for x in first] for p in range(parts)]

    def near(x, p):
        return min((sum((a - b) ** 2 for a, b in zip(x[p * width : (p + 1) * width], entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        codes = [[near(x, p)[1] for p in range(parts)] for _, _, x in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[p * width : (p + 1) * width] for (_, _, x), c in zip(kept, codes) if c[p] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    out = sorted(((i is None, i or 0), bytes(near(x, p)[1] for p in range(parts)), sum(near(x, p)[0] for p in range(parts))) for i, _, x in kept)
    return out, books


def vectors(seed, n, dims=16):
    r = random.Random(seed)
    rows = [(i, [float(np.float32(r.gauss(0, 0.3))) for _ in range(dims)]) for i in range(n)]
    rows += [(3, [0.0] * dims), (3, [0.0] * dims), (None, [0.25] * dims), (None, None), (n, [None] * dims), (n, [math.nan] * dims), (n, [math.inf] + [0.0] * (dims - 1))]
    rows += [(n + i, [r.choice([-0.25, 0.0, 0.25])] * dims) for i in range(40)]  # ties
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame([(i, v, (i or 0) % 3 or None, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    got, books, looked = vector_codes.compress(df.drop("codes"), **how)
    return got, sorted(((r["vec_id"] is None, r["vec_id"] or 0), bytes(r["codes"]), r["error"]) for r in got.collect()), books, looked


@pytest.mark.parametrize("entries,groups", [(16, 4), (5, 1), (40, 7)])
def test_against_plain_lloyd(spark, entries, groups):
    rows = vectors(entries, 150)
    _, got, books, _ = run(spark, rows, parts=4, entries=entries, groups=groups, rounds=4)
    want, want_books = plain(rows, 4, entries, 4)
    assert got == want
    assert books.entries.tolist() == want_books
    flat = ",".join(str(c) for book in want_books for entry in book for c in entry)
    assert books.digest() == hashlib.sha256(flat.encode()).hexdigest()


def test_bounds_spare_work(spark):
    """After the first round most groups are not scanned."""
    _, _, books, looked = run(spark, vectors(1, 400), parts=4, entries=16, groups=4, rounds=6)
    assert looked[0] > looked[-1] and looked[-1] < 0.7 * looked[0]


def test_lengths_and_few_rows(spark):
    rows = [(2, [0.5, -0.5, 1.0]), (1, []), (3, [1.0] * 9), (4, [-1e-9] * 9)]
    _, got, books, _ = run(spark, rows, parts=8, entries=16, groups=4, rounds=2)
    assert got == plain(rows, 8, 16, 2)[0] and books.entries.shape == (8, 4, 2)
    _, got, books, _ = run(spark, [(1, []), (2, [])], parts=8)
    assert [g[1:] for g in got] == [(bytes(8), 0)] * 2 and books.digest() == hashlib.sha256(b"").hexdigest()


def test_no_rows_and_large_numbers(spark):
    for rows in ([], [(1, None), (2, [math.nan])]):
        frame, got, _, _ = run(spark, rows)
        assert got == [] and frame.columns == ["vec_id", "label", "__group", "codes", "error"]
    with pytest.raises(ValueError):
        run(spark, [(1, [1e30] * 8)])


@pytest.mark.parametrize("few", [100_000, 2])
def test_sums_of_groups(spark, monkeypatch, few):
    from tenderloom.llm import shared

    monkeypatch.setattr(shared, "FEW_GROUPS", few)
    rows = [(i, g, i) for i, g in enumerate([None] * 5 + ["a"] * 9 + ["b", "c", "d", "e"])]
    df = spark.createDataFrame(rows, "id long, g string, v long")
    got = {(r["id"], r["g"]): r["s"] for r in vector_codes.with_group_sums(df, "g", "v", "s").collect()}
    assert got == {(i, g): sum(v for _, h, v in rows if h == g) for i, g, _ in rows}

import hashlib
import random

import numpy as np

from tenderloom.llm import suffix_dedup
from tenderloom.llm.queries import op2_suffix_dedup

DATA = "/root/testdata/sf0.001"


def brute(rows):
    """(id, text) -> (removed, spans, kept) by looking every string up."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if i is not None:
                first[b[p : p + 50]] = min(first.get(b[p : p + 50], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if i is not None and first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out.append((i, len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup(df).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_passages_copies_and_edits(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8)))
    base = [" ".join(word() for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = rng.sample(base, 2)
        text = parts[0] + " " + word() + " " + parts[1][rng.randint(0, 200) :]
        if i % 5 == 0:
            text = rows[-1][1] if rows else text
        if i % 7 == 0:
            at = rng.randint(0, len(text))
            text = text[:at] + "é" + text[at:]
        rows.append((i, text))
    check(spark, rows)


def test_edges_of_fifty_bytes(spark):
    shared = "0123456789" * 4 + "abcdefghij"
    rows = [(5, "x" + shared + "y"), (9, shared), (2, shared[:-1]), (7, "q" * 200), (8, "q" * 200), (11, "q" * 90 + shared + shared), (12, None), (13, ""), (None, shared), (9, shared + "!"), (1, shared[1:] + shared[:25])]
    check(spark, rows)


def test_extra_columns_and_no_rows(spark, docs, none):
    assert suffix_dedup.dedup(docs).count() == docs.count()
    assert suffix_dedup.dedup(none).count() == 0


def test_query_is_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = op2_suffix_dedup(spark, DATA).collect()
    want = [(*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in brute(rows)]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)


def test_many_shards_and_levels(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 300)
    monkeypatch.setattr(suffix_dedup, "BATCH", 50)
    test_passages_copies_and_edits(spark)


def test_equal_hashes_of_other_bytes_remove_nothing(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "mix", lambda x: x & np.uint64(0xFF))
    test_passages_copies_and_edits(spark)


def test_family_is_a_logarithmic_index_of_sorted_bytes():
    rng, f = np.random.default_rng(0), suffix_dedup.SuffixFamily(6400)
    data = rng.integers(0, 256, 40_000, dtype=np.uint8)
    data[20_000:] = data[:20_000]
    data[30_000] ^= 1
    at, ids = rng.integers(0, 39_950, 6400), rng.integers(0, 50, 6400)
    for s in range(0, 6400, 100):
        f.add(suffix_dedup.columns(data, at[s : s + 100]), ids[s : s + 100], np.arange(s, s + 100))
        assert len(f.levels) <= 8
    strings, least = [data[p : p + 50].tobytes() for p in at.tolist()], {}
    for p, i in zip(strings, ids.tolist(), strict=True):
        least[p] = min(i, least.get(p, i))
    assert f.marked().tolist() == [least[p] < i for p, i in zip(strings, ids.tolist(), strict=True)]
    for _, _, number in f.levels:
        level = [strings[n] for n in number]
        assert level == sorted(set(level))


def test_few_packed_rows_between_many_shards(spark, monkeypatch):
    """Senders and receivers stay large, so that their pairs stay few where the shards are many."""
    from tenderloom.llm.shared import Tables

    rng, written, write = random.Random(5), {}, Tables.write

    def counted(self, name, df, rows=1000):
        out = write(self, name, df, rows)
        written[name] = out.count()
        return out

    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(2, 8)))
    shared = [" ".join(word() for _ in range(40)) for _ in range(100)]
    rows = [(i, " ".join(rng.choice(shared) if k % 3 else " ".join(word() for _ in range(30)) for k in range(6))) for i in range(500)]
    monkeypatch.setattr(Tables, "write", counted)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)
    check(spark, rows)
    assert 0 < written["grams"] < 1500 and 0 < written["marks"] < 1500


def test_grams_dealt_in_many_turns(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GRAMS", 100)
    monkeypatch.setattr(suffix_dedup, "STEP", 2000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 5000)
    monkeypatch.setattr(suffix_dedup, "LEAST_SHARDS", 2)
    test_passages_copies_and_edits(spark)


def test_more_rows_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BROADCAST_ROWS", 0)
    test_edges_of_fifty_bytes(spark)
    test_passages_copies_and_edits(spark)

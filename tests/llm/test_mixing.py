import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tenderloom.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rows, n = [], 0
    for s, (source, docs) in enumerate([("b", 300), ("a", 40), (None, 25), ("é", 10), ("", 5), ("empty", 3)]):
        for i in range(docs):
            size = 0 if source == "empty" else (7 * i + s) % 90
            rows.append((n if i % 9 else None, " ".join(f"{source}{n}-{k}" for k in range(size)) if size or i % 2 else None, source))
            n += 1
    return rows + [(1, "again again", "b"), (1, "again again", "b"), (2, " \t", "b"), (3, "very long " * 30_000, "a")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, source string, size int, part string, index int").repartition(4)


def plain_targets(words):
    """Shares by weight, with the excess shared again and again."""
    order = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, rest = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(words.values())
    while rest > 1e-9 and free:
        share = rest / sum(weight[s] for s in free)
        rest = 0.0
        for s in list(free):
            target[s] += share * weight[s]
            if target[s] >= 2 * words[s]:
                rest += target[s] - 2 * words[s]
                target[s] = 2.0 * words[s]
                free.discard(s)
    return target


def test_targets_words_and_reruns(spark):
    rows = corpus()
    got = mixing.taken(mixing.mix(frame(spark, rows))).collect()
    sizes = Counter((i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    assert Counter((r["doc_id"], r["size"]) for r in got) == sizes
    words = defaultdict(int)
    for _, t, s in rows:
        words[s] += len(WORD.findall(t or ""))
    targets = plain_targets(words)
    by_size = defaultdict(set)
    for s, w in words.items():
        by_size[w].add(s)
    taken = Counter()
    for r in got:
        (source,) = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(targets[source])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 2 * mixing.BLOCK for s in words)
    again = mixing.taken(mixing.mix(frame(spark, rows).repartition(7))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_small_parts_agree(spark, monkeypatch):
    """Many chunks, groups of shards and joined source tables give the same targets and hold the same bounds."""
    from tenderloom.llm import shared

    rows = corpus()
    for name, value in (("SHARD", 8), ("SHARD_GROUP", 3), ("CHUNK", 10), ("FEW_GROUPS", 2)):
        monkeypatch.setattr(mixing, name, value)
    monkeypatch.setattr(shared, "FEW_GROUPS", 2)
    mixed = mixing.mix(frame(spark, rows))
    due = {r["index"]: r["due"] for r in mixed.sources.collect()}
    slots = mixed.slots.collect()
    assert Counter(s["index"] for s in slots) == Counter({i: n for i, n in due.items() if n})
    times = Counter((s["index"], s["turn"], s["block"]) for s in slots)
    assert set(times.values()) == {1}  # each round through a source takes a block once
    docs = mixed.docs.collect()
    assert len(docs) == len(rows)
    for i in due:  # documents lie end to end
        end = 0
        for d in sorted((d for d in docs if d["index"] == i), key=lambda d: (d["first"], d["size"])):
            assert d["first"] == end
            end += d["size"]
    assert all(r["taken"] <= 2 * r["size"] for r in mixing.taken(mixed).collect())


def test_texts_of_blocks(spark):
    rows = corpus()
    mixed = mixing.mix(frame(spark, rows), with_text=True)
    texts = mixing.block_texts(mixed).collect()
    assert len(texts) == mixed.slots.count()
    held = defaultdict(Counter)
    for _, t, s in rows:
        held[s].update(WORD.findall(t or ""))
    got = defaultdict(Counter)
    for r in texts:
        words = r["text"].split(" ")
        assert len(words) <= mixing.BLOCK
        got[r["source"]].update(words)
    for s, words in got.items():
        assert all(n <= 2 * held[s][w] for w, n in words.items())
    taken = mixing.taken(mixed).agg(F.sum("taken")).first()[0]
    assert sum(sum(c.values()) for c in got.values()) == taken


def test_permutations(spark):
    for n in (1, 2, 3, 64, 1000):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), mixing.turn_keys(F.lit(5).cast("long"), 1, F.lit(n).cast("long"))).alias("x"))
        got = [r["x"] for r in df.collect()]
        assert sorted(got) == list(range(n))
    assert got != sorted(got) and sum(abs(a - i) for i, a in enumerate(got)) / n > 200  # a random one: 333


def test_draws_are_multinomial(spark):
    """Chi-square of the counts in 200 shards of 1,024 draws, three sources, one of half the slots."""
    sources = spark.createDataFrame([(0, 0, 102_400), (1, 102_400, 61_440), (2, 163_840, 40_960)], "index long, first_slot long, due long")
    counts = mixing.draw(spark, sources, 204_800, True).collect()
    share = (0.5, 0.3, 0.2)
    square = sum((r["n"] - 1024 * share[r["index"]]) ** 2 / (1024 * share[r["index"]]) for r in counts)
    assert sum(r["n"] for r in counts) == 204_800 and 320 < square < 490  # 400 degrees of freedom, sd 28


def test_nothing_to_mix(spark):
    assert mixing.taken(mixing.mix(frame(spark, []))).collect() == []
    got = mixing.taken(mixing.mix(frame(spark, [(1, None, "a"), (1, None, "a"), (None, " ", None)]))).collect()
    assert sorted(map(str, got)) == sorted(["Row(doc_id=1, size=0, source_size=0, target=0.0, taken=0)"] * 2 + ["Row(doc_id=None, size=0, source_size=0, target=0.0, taken=0)"])


def test_plan_is_native(spark, capsys):
    mixing.taken(mixing.mix(frame(spark, corpus()))).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan

import itertools
import random
import re

from tenderloom.llm import decontaminate

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
OTHER = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def found(spark, texts, items=((1, ITEM), (2, OTHER), (3, None), (4, "too short to count"))):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): (r["overlap_tokens"], r["matched_tokens"]) for r in decontaminate.contaminated(docs, bench).collect()}


def test_masks_reach_every_two_replaced_of_thirteen():
    for lost in itertools.combinations(range(decontaminate.LEAST), 2):
        assert any(all(o + k not in lost for k in mask) for mask in decontaminate.MASKS for o in range(decontaminate.LEAST - decontaminate.SPAN + 1))


def test_overlaps(spark):
    words = ITEM.split()
    swapped = [w if i not in (3, 9) else "xx" for i, w in enumerate(words)]
    many = [w if i % 3 else "xx" for i, w in enumerate(words)]
    texts = ["before " + ITEM.upper().replace(" ", ", ") + " after", " ".join(swapped), " ".join(many), " ".join(words[:12]), " ".join(words[2:15]), None, "", ITEM + " and then " + OTHER, "clean words only " * 20]
    got = found(spark, texts)
    assert got == {(0, 1): (16, 16), (1, 1): (16, 14), (4, 1): (13, 13), (7, 1): (16, 16), (7, 2): (15, 15)}


def test_whole_rows_and_empty_tables(spark, docs, none):
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert sorted(decontaminate.clean(docs, bench).collect(), key=str) == sorted(docs.collect(), key=str)
    assert decontaminate.contaminated(none, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == docs.count()


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(i, f"w{i} " + " ".join(f"t{i}x{j}" for j in range(15))) for i in range(12)]
    texts = [t for _, t in items]
    whole = found(spark, texts, items)
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 40)
    assert found(spark, texts, items) == whole and len(whole) == 12


def test_short_items_are_found_whole(spark):
    items = [(1, "Who wrote it?"), (2, "one two three four five six seven"), (3, "who wrote it"), (4, "zebra"), (5, "?!"), (6, ITEM)]
    texts = ["so: who WROTE, it then. Who wrote it", "one two three four five six", "x one two three four five six seven y", "who wrote", "one two three four xx six seven", "zebra", "?!", "it who wrote", None]
    assert found(spark, texts, items) == {(0, 1): (3, 3), (0, 3): (3, 3), (2, 2): (7, 7), (5, 4): (1, 1)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, bench, least_tokens=1).collect()) == [1, 3, 4, 6, 7, 8]
    assert {r["doc_token"] for r in decontaminate.contaminated(docs, bench).filter("doc_id = 0").collect()} == {1}


def brute(texts, items):
    """The best stretch of every item in every text, over all ways to lay one over the other."""
    cut = lambda t: re.findall(r"(?:[0-9a-z]|[^\x00-\x7f])+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    out = {}
    for (d, text), (i, item) in itertools.product(enumerate(texts), items):
        a, b, best = cut(text), cut(item), None
        if sum(x in set(b) for x in a) < 0.8 * min(len(b), decontaminate.LEAST):
            continue  # too few tokens in common for any stretch
        for shift in range(-len(b) + 1, len(a)):
            left, right = max(0, -shift), min(len(b), len(a) - shift)
            same = [a[shift + j] == b[j] for j in range(left, right)]
            for s in range(len(same)):
                total = 0
                for e in range(s, len(same)):
                    total += 1 if same[e] else decontaminate.MISMATCH
                    if same[s] and same[e] and total > 0 and e - s + 1 >= min(decontaminate.LEAST, len(b)) and (len(b) >= decontaminate.SPAN or all(same[s : e + 1])):
                        best = max(best or (0, 0, 0, 0), (e - s + 1, -(shift + left + s), sum(same[s : e + 1]), left + s))
        if best:
            out[d, i] = (best[0], best[2])
    return out


def test_as_by_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"t{rng.randint(0, 60)}" for _ in range(rng.choice((3, 7, 8, 13, 20, 30))))) for i in range(12)]
    texts = []
    for _ in range(40):
        words = [f"u{rng.randint(0, 60)}" for _ in range(rng.randint(0, 15))]
        for _, item in rng.sample(items, 2):
            part = item.split()
            part = part[rng.randint(0, 2) : len(part) - rng.randint(0, 2)]
            for _ in range(rng.randint(0, 3)):
                if part:
                    part[rng.randrange(len(part))] = f"x{rng.randint(0, 9)}"
            words += part + [f"u{rng.randint(0, 60)}" for _ in range(rng.randint(0, 5))]
        texts.append(" ".join(words))
    texts += ["t1 " * 300, None]
    items += [(20, "t1 " * 40), (20, "t1 " * 40)]
    assert found(spark, texts, items) == brute(texts, items)
    hits = decontaminate.HITS
    decontaminate.HITS = 50
    try:
        assert found(spark, texts, items) == brute(texts, items)
    finally:
        decontaminate.HITS = hits


def test_blocks_are_bound_by_tokens_not_blanks(spark, monkeypatch):
    """Items whose words are parted by commas alone; and items of a word or two, which take no document away."""
    monkeypatch.setattr(decontaminate, "BLOCK_TOKENS", 1000)
    items = [(i, ",".join(f"w{i}x{k}" for k in range(500))) for i in range(12)] + [(99, "the"), (98, "of a")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    sizes = [len(index.tokens) for index in decontaminate.benchmark_blocks(bench)]
    assert sum(sizes) == 6003 and max(sizes) <= 3000
    docs = spark.createDataFrame([(1, "the end of a tale, it is"), (2, "so " + items[3][1].replace(",", " "))], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).collect()] == [1]
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(1, 99), (1, 98), (2, 3)}

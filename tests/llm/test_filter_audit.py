import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from tenderloom.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int, part string"


def plain_mask(text):
    words = WORD.findall(text)
    caps = len(re.findall("[A-Z]", text))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * caps > 3 * len(text)) << 2 | bool(re.search(r"[#$%&*|]", text)) << 3


def plain(docs, labels):
    """The whole table by one loop over documents, orders and steps."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = defaultdict(Counter)
    for i, t, lang in docs:
        mask = plain_mask(t or "") | (i is not None and i > least[t or ""]) << 4
        fails = {f for k, f in enumerate("ABCDE") if mask >> k & 1}
        for order in permutations("ABCDE"):
            gone = next((s for s, f in enumerate(order, 1) if f in fails), 6)
            for s, f in enumerate(order, 1):
                at = out[lang or "", "".join(order), s]
                at["kept"] += gone > s
                at["removed"] += gone == s
                at["redundant"] += f in fails and gone < s
                at["unique_fails"] += fails == {f}
                at["good_lost"] += gone == s and i in good
                at["toxic_lost"] += gone == s and i in toxic
    shapley = Counter()
    for (part, order, s), at in out.items():
        shapley[part, order[s - 1]] += at["removed"]
    return {(*k, *(v[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")), shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def corpus(seed):
    r = random.Random(seed)
    texts = [None, "", " \t\n", "a", "É" * 5, "word " * 300, "x\x0by\x1cz\x85 " * 80, "UPPER CASE " * 150, "a b", "# tail"]
    for _ in range(60):
        words = [r.choice(["one", "Two", "THREE", "naïve", "日本", "$", "w%d" % r.randrange(400)]) for _ in range(r.choice([3, 150, 199, 200, 201, 400]))]
        texts.append(r.choice([" ", "\n", "  "]).join(words))
    ids = [*range(50), 3, 3, None, None, -4]
    return [(r.choice(ids), r.choice(texts), r.choice(["en", "de", None, ""])) for _ in range(220)] + [(5, "same", "en"), (5, "same", "en"), (None, "same", "en"), (6, "same", "de")]


def run(spark, docs, labels):
    d = spark.createDataFrame([(*row, "x", 1) for row in docs], "doc_id long, text string, lang string, part string, mask int").repartition(3)
    got = filter_audit.audit(d, spark.createDataFrame([(*row, "x") for row in labels], LABELS)).collect()
    assert len({tuple(r)[:3] for r in got}) == len(got)
    return {tuple(r) for r in got}


def test_against_loops(spark):
    docs = corpus(1)
    labels = [(i % 40, i % 2, i % 3 % 2) for i in range(60)] + [(None, 1, 1), (7, None, None), (999, 1, 1)]
    assert run(spark, docs, labels) == plain(docs, labels)


def test_empty(spark):
    assert run(spark, [], [(1, 1, 1)]) == set()
    one = run(spark, [(1, None, None)], [])
    assert len(one) == 600 and {r[0] for r in one} == {""} and {r[-1] for r in one} == {0, 120}


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_counts_of_slices(kind):
    texts = [t for _, t, _ in corpus(2)] + ["long " * 200_000]
    whole = pa.array(["before", *texts, "after"], kind)
    got = filter_audit.counts(whole.slice(1, len(texts)))
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        assert got["words"][i] == len(words) and got["distinct"][i] == len(set(words)) and got["points"][i] == len(t or "")
    assert filter_audit.failed(got).tolist() == [plain_mask(t or "") for t in texts]


def test_words_that_share_a_hash(monkeypatch):
    """Hashes only order words; what is counted is verified."""
    texts = [t for _, t, _ in corpus(3)]
    want = filter_audit.counts(pa.array(texts, pa.string()))["distinct"]
    monkeypatch.setattr(filter_audit, "word_hashes", lambda data, a, b: np.zeros(len(a), np.uint64))
    assert filter_audit.counts(pa.array(texts, pa.string()))["distinct"].tolist() == want.tolist()
    monkeypatch.setattr(filter_audit, "word_hashes", lambda data, a, b: (b - a).astype(np.uint64))
    assert filter_audit.counts(pa.array(texts, pa.string()))["distinct"].tolist() == want.tolist()

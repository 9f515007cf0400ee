"""TF-IDF over whole texts: each text is split once, whatever share of the terms is broadcast."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tenderloom.functions import text as t
from tenderloom.operators import retrieval as r

TEXTS = ["the red the blue", "Red RED gear, ёлка", "", None, "the", "blue-gear №7 the", "x y z"]
ASKED = [(1, "the"), (1, "red"), (2, "gear"), (2, "nowhere"), (3, "елка")]


def plain():
    """Scores as the query's SQL states them; texts of one key count as one."""
    tf = {}
    for i, text in enumerate(TEXTS):
        tf.setdefault(i % 6, Counter()).update(re.findall("[0-9a-zа-я]+", (text or "").lower().replace("ё", "е")))
    df = Counter(w for c in tf.values() for w in c)
    idf = {w: math.log((len(TEXTS) + 1) / (k + 1)) + 1 for w, k in df.items()}
    out = {}
    for query in {q for q, _ in ASKED}:
        words = [w for q, w in ASKED if q == query and w in idf]
        for key, c in tf.items():
            if held := [w for w in words if w in c]:
                norm = math.sqrt(sum(((1 + math.log(n)) * idf[w]) ** 2 for w, n in c.items()))
                out[query, key] = sum((1 + math.log(c[w])) * idf[w] ** 2 for w in held) / norm / math.sqrt(sum(idf[w] ** 2 for w in words))
    return out


@pytest.mark.parametrize("most", [100_000, 3, 0])
def test_shares_of_terms(spark, tmp_path, monkeypatch, most):
    spark.createDataFrame([(i % 6, x) for i, x in enumerate(TEXTS)], "k long, text string").write.parquet(str(tmp_path / "documents"))
    least = r.least_common
    monkeypatch.setattr(r, "least_common", lambda df: least(df, most))
    out = r.tfidf(spark.read.parquet(str(tmp_path / "documents")), spark.createDataFrame(ASKED, "query_id int, term string"), "k", "text")
    got = {(x["query_id"], x["k"]): x["score"] for x in out.collect()}
    assert got == pytest.approx(plain())
    assert not [f for f in out.inputFiles() if "documents" in f]  # texts are split before, once


def test_least_common(spark):
    df = spark.createDataFrame([(f"w{i}", 1) for i in range(50)] + [(f"v{i}", 8) for i in range(4)] + [("u", 900)], "term string, df long")
    for most, held in ((0, 0), (1, 1), (4, 1), (5, 5), (54, 5), (55, 55)):
        assert df.filter(F.floor(F.log2("df") * 4) >= r.least_common(df, most)).count() == held


def test_long_tokens(spark):
    odd = ["", None, " ", "Ёж-ёж", "a1,b2", "İI K Å ß ΣΑΣ", "日本 x😀y", "\ttab\x00nul\n", "…", "Ў і ј я"]
    df = spark.createDataFrame([(x,) for x in odd], "text string").select(t.tokens(F.col("text")).alias("a"), t.long_tokens(F.col("text")).alias("b"))
    assert all(x["a"] == x["b"] for x in df.collect())

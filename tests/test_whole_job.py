"""Queries against their SQL without the cuts that it still has: every offer, lot, document, query vector and supplier."""

import numpy as np
import pandas as pd
import pytest
from test_queries import DATA, duck, rows  # noqa: F401

from tenderloom.plans import register

OFFERS = " AND (offer_id % 7 < 2 OR offer_id % 11 = supplier_id % 11)"


def whole(duck, name, *cuts):  # noqa: F811
    """The SQL of ``name`` with every (old, new) of ``cuts`` replaced."""
    sql = register.SQL[name]
    for old, new in cuts:
        sql = sql.replace(old, new)
    return duck.sql(sql).df()


@pytest.mark.parametrize("name", ["match_resolution", "component_scores", "weighted_score", "policy_status", "final_candidates", "candidate_highlights"])
def test_every_current_offer(spark, duck, name):  # noqa: F811
    assert rows(register.QUERIES[name](spark, DATA).toPandas()) == rows(whole(duck, name, (OFFERS, "")))


def test_every_lot(spark, duck):  # noqa: F811
    assert rows(register.QUERIES["position_evidence"](spark, DATA).toPandas()) == rows(whole(duck, "position_evidence", (" WHERE lot_id % 20 = 0", "")))


def test_first_purchase_of_equal_words(spark):
    from tenderloom.operators import ranking

    positions = spark.createDataFrame([("p", ["red"])], "item_id string, required array<string>")
    purchases = spark.createDataFrame([(1, 5, 2, ["red"]), (1, 9, None, ["red"]), (1, 7, 2, ["red"]), (1, 8, 1, ["red", "rod"]), (2, 3, None, ["red"])], "supplier_id long, lot_id long, priority long, words array<string>")
    got = ranking.position_evidence(positions, purchases).select("item_id", "supplier_id", "lot_id").collect()
    assert sorted(map(tuple, got)) == [("p", 1, 7), ("p", 2, 3)]


def test_every_document(spark, tmp_path):
    spark.range(3, 1203).selectExpr("id AS doc_id", "concat('text ', id) AS text").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [r["doc_id"] for r in register.QUERIES["pending_vectors"](spark, str(tmp_path)).collect()]
    assert got == [i for i in range(3, 1203) if i % 3 == 0 or i % 5 == 0]


def test_every_query_vector(spark, duck):  # noqa: F811
    assert rows(register.QUERIES["vector_channel"](spark, DATA).toPandas()) == rows(whole(duck, "vector_channel", ("vec_id < 3", "vec_id % 20 = 0")))


def test_top_of_each_label(spark):
    e = pd.read_parquet(f"{DATA}/embeddings.parquet")
    v = np.stack(e["embedding"]).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = set()
    for q in np.flatnonzero(e["vec_id"] % 20 == 0):
        e["s"], e["name"] = np.round(v @ v[q], 6), e["vec_id"].astype(str)
        for label, part in e.sort_values(["s", "name"], ascending=[False, True]).groupby("label"):
            want |= {(int(e["vec_id"][q]), label, int(i)) for i in part["vec_id"].head(3)}
    got = register.QUERIES["cosine_topk"](spark, DATA).toPandas()
    assert set(zip(got["query_id"], got["label"], got["vec_id"], strict=True)) == want and len(got) == len(want)


def test_equal_vectors_by_key(spark):
    from tenderloom.operators import vectors

    v = spark.createDataFrame([(i, [1.0, 0.0], "a" if i < 30 else None) for i in range(40)], "k long, v array<double>, g string").repartition(3)
    q = spark.createDataFrame([(7, [2.0, 0.0])], "query_id long, vector array<double>")
    assert sorted(r["k"] for r in vectors.nearest(v, q, "k", "v", 3).collect()) == [0, 1, 10]
    assert sorted((r["g"] or "", r["k"]) for r in vectors.nearest(v, q, "k", "v", 2, by="g").collect()) == [("", 30), ("", 31), ("a", 0), ("a", 1)]


def test_three_hundred_suppliers(spark, tmp_path, monkeypatch):
    from tenderloom.plans import search

    many = spark.range(400).selectExpr("id AS supplier_id", "'22.40' AS category", "id AS position", "current_timestamp() AS seen")
    monkeypatch.setattr(search, "_cards", lambda spark, d: many)
    assert search.best_cards(spark, str(tmp_path)).count() == 300

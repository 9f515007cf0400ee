"""Versions, leakage, scores, fusion, policy, evaluation on small tables."""

import math
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tenderloom.operators import classify, evaluate, history, quality, ranking, retrieval, state, vectors


def test_deleted_version_brings_nothing_back(spark):
    rows = spark.createDataFrame([(1, 1, 0), (1, 3, 1), (1, 2, 0), (2, 1, 0), (3, 5, 1), (3, 6, 0)], "k int, version int, is_deleted int")
    got = state.current(rows, ["k"], [F.desc("version")], F.col("is_deleted") == 1)
    assert sorted((r["k"], r["version"]) for r in got.collect()) == [(2, 1), (3, 6)]


def test_withdraw_only_what_was_absent(spark):
    at = lambda d: datetime(2024, 1, d)
    rows = spark.createDataFrame([(1, "s", at(1), "available", 5, 0), (2, "s", at(9), "available", 5, 0), (3, "s", at(1), "unavailable", 5, 0), (4, "t", at(1), "available", 5, 0)], "id int, source string, updated_at timestamp, availability string, version long, is_deleted int")
    got = state.withdraw_absent(rows, F.col("source") == "s", F.lit(at(5)), F.lit(100)).collect()
    assert [(r["id"], r["availability"], r["version"]) for r in got] == [(1, "unavailable", 100)]


def test_fusion_anchor(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("b", "x", 1), ("a", "y", 1)], "channel string, supplier string, rank int")
    got = {r["supplier"]: r["fusion"] for r in retrieval.rrf(rows, "supplier", 2).collect()}
    assert got["x"] == pytest.approx((1 / 62 + 1 / 61) / (2 / 61))
    assert got["y"] == pytest.approx((1 / 61) / (2 / 61))


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "red bolt red"), (2, "blue bolt"), (3, "nut"), (4, None)], "id int, text string")
    q = spark.createDataFrame([(1, "red"), (1, "bolt")], "query_id int, term string")
    got = {r["id"]: r["score"] for r in retrieval.bm25(docs.filter("text is not null"), q, "id", "text").collect()}
    n, mean = 3, 2.0
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, size: tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))
    assert got == {1: pytest.approx(idf(1) * part(2, 3) + idf(2) * part(1, 3)), 2: pytest.approx(idf(2) * part(1, 2))}


def test_nearest_is_exact(spark):
    v = spark.createDataFrame([(i, [float(i % 5), float(i % 7), 1.0]) for i in range(60)], "id long, v array<float>")
    got = vectors.nearest(v, v.filter("id < 3").select(F.col("id").alias("query_id"), F.col("v").alias("vector")), "id", "v", 4).collect()
    assert len(got) == 12 and all(r["similarity"] <= 1.0000001 for r in got)
    assert {r["query_id"] for r in got if r["id"] == r["query_id"]} == {0, 1, 2}


def test_lexical_plan_has_no_cross_join(spark, capsys):
    docs = spark.createDataFrame([(1, "red bolt")], "id int, text string")
    q = spark.createDataFrame([(1, "red")], "query_id int, term string")
    retrieval.bm25(docs, q, "id", "text").explain()
    assert "Cartesian" not in capsys.readouterr().out


def test_policy_reasons(spark):
    row = spark.createDataFrame([(True, False, "reseller", True, True, False, 0.6, False), (False, None, "unknown", True, True, False, 0.4, False)], "has_inn boolean, conflict boolean, role string, role_evidenced boolean, current_offer boolean, only_inferred boolean, coverage double, enrichment_failed boolean")
    got = [(r["status"], r["reasons"]) for r in ranking.policy(row).collect()]
    assert got == [("recommended", []), ("check", ["inn_missing", "identity_conflict", "role_unconfirmed", "range_unconfirmed"])]


def test_participation_labels(spark):
    rows = spark.createDataFrame([("l", "a", True), ("l", "a", False), ("l", "b", True), ("l", "b", True), ("l", "c", None)], "lot_id string, supplier_inn string, is_winner boolean")
    got = {r["supplier_inn"]: (r["is_winner"], r["label_conflict"]) for r in history.participations(rows).collect()}
    assert got == {"a": (True, True), "b": (True, False), "c": (False, True)}


def test_target_procedures_lie_whole_in_the_window(spark):
    info = spark.createDataFrame([("1", "p", date(2020, 1, 5), False), ("2", "p", date(2020, 3, 1), False), ("3", None, date(2020, 1, 7), False), ("4", None, date(2020, 1, 8), True)], "lot_id string, procedure_id string, publish_date date, notice_conflict boolean")
    got = history.targets(info, history.procedure_dates(info), "2020-01-01", "2020-02-01")
    assert [r["lot_id"] for r in got.collect()] == ["3"]


def test_metrics_count_misses(spark):
    rows = spark.createDataFrame([([1, 2, 3], [2, 9], 2), ([1], [5], 5)], "candidates array<int>, participants array<int>, winner int")
    r = evaluate.summary(evaluate.query_metrics(rows)).first()
    assert (r["mrr"], r["winner_recall"], r["recall"], r["hit_1"]) == (0.25, 0.5, 0.25, 0.0)


def test_bootstrap_interval(spark):
    rows = spark.createDataFrame([(i, 1.0 + (i % 3) / 10) for i in range(300)], "c int, d double")
    r = evaluate.paired_bootstrap(rows, "c", "d", 300).first()
    assert r["low"] < r["mean"] < r["high"] and r["high"] - r["low"] < 0.05
    assert evaluate.accepted({"mean": r["mean"], "low": r["low"]}, 0.5, 0.495) and not evaluate.accepted({"mean": r["mean"], "low": -1}, 0.5, 0.5)


def test_splits_must_keep_a_gap():
    good = [{"name": n, "history_before": b, "start": s, "end": e} for n, b, s, e in (("train", "2020-01-01", "2020-02-01", "2020-03-01"), ("validation", "2020-02-01", "2020-03-05", "2020-04-01"), ("test", "2020-03-01", "2020-04-05", "2020-05-01"))]
    evaluate.check_splits(good)
    with pytest.raises(ValueError):
        evaluate.check_splits([good[0] | {"history_before": "2020-01-20"}, *good[1:]])


def test_cascade_takes_the_strongest_well_formed(spark):
    row = spark.createDataFrame([("bad", "22.4", None), (None, None, None)], "g string, a string, l string")
    got = classify.cascade(row, {"gold": "g", "archive": "a", "lexicon": "l"}).collect()
    assert [(r["code"], r["method"], r["confidence"]) for r in got] == [("22.4", "archive", 0.8), ("", "none", 0.0)]


def test_validation_and_digests(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 7.0), (3, None)], "id int, confidence double")
    checked = quality.validate(df, {"confidence": F.col("confidence").between(0, 1)})
    assert quality.accepted(checked).count() == 1 and quality.rejected(checked).count() == 2
    assert quality.same_pass(df, df.orderBy(F.desc("id")), "id", 3) and not quality.same_pass(df, df, "id", 4)
    assert quality.same_sets(df, df) and not quality.same_sets(df, df.limit(2))


def test_all_categories_of_a_level(spark):
    from tenderloom.operators import analytics

    kept = "'website' AS source_type, timestamp'2001-01-01' AS last_seen_at, 'available' AS availability, 7L AS supplier_id, 'verified' AS seller_status, true AS has_attributes, 'none' AS classification_method, 1.0D AS price"
    df = spark.range(2500).selectExpr("concat(lpad(id % 50, 2, '0'), '.', lpad(id div 50, 2, '0'), '.1') AS okpd2_code", *kept.split(", "))
    got = analytics.categories(df, analytics.Measures("2001-06-01")).groupBy("level").count().collect()
    assert sorted(map(tuple, got)) == [(1, 50), (2, 2500)]


def test_pool_is_picked_before_the_latest_version(spark, monkeypatch):
    from tenderloom.plans import mapping, search

    seen, latest = [], mapping.current_offers
    monkeypatch.setattr(mapping, "current_offers", lambda v: seen.append(v.count()) or latest(v))
    monkeypatch.setattr(search.r, "pool", lambda docs, order, most: docs.filter("hits > 0").orderBy(*order).limit(3))
    search.lexical_channel(spark, "/root/testdata/sf0.001").count()
    assert 0 < seen[0] < 0.1 * mapping.offer_versions(spark, "/root/testdata/sf0.001").count()

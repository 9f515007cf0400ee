"""Texts kept up to date equal a rebuild after every batch."""

import random
import re

from tenderloom.streaming.lot_texts import LOGS, LotTexts


def rows(df):
    return sorted(tuple(r) for r in df.select("lot_id", "title", "text", "terms", "participants", "winners").collect())


def test_random_batches(spark, tmp_path):
    r = random.Random(2)
    texts = LotTexts(spark, str(tmp_path), buckets=8)
    assert texts.refresh() == 0 and texts.read().count() == 0
    for version in range(1, 6):
        ids = range(40) if version == 1 else r.sample(range(45), 4)
        lots = [(i, r.choice(["Ёлка", "", None, "pipes"]), r.choice([None, "tender"]), version, r.random() < 0.2) for i in ids] + [(None, "x", "y", version, 0)]
        items = [(i, k, r.choice(["bolt", "nut", None, "Gear"]), version, r.random() < 0.3) for i in ids for k in range(3)]
        part = [(i, s, r.choice([True, False, None]), version, r.random() < (0.2 if version == 1 else 0.6)) for i in ids for s in range(r.randrange(3))]
        for log, held in zip(LOGS, (lots, items, part), strict=True):
            texts.append(log, spark.createDataFrame([(*x[:-1], int(x[-1])) for x in held], LOGS[log][0]))
        seen = texts.refresh()
        assert seen == (40 if version == 1 else 4)
        assert rows(texts.read()) == rows(texts.rebuild())
        assert texts.refresh() == 0
    texts.append("lots", spark.createDataFrame([(3, "late", "late", 1, 0)], LOGS["lots"][0]))
    assert texts.refresh() == 0 and texts.refresh(everything=True) > 0
    assert rows(texts.read()) == rows(texts.rebuild())


def test_only_the_buckets_of_a_batch_are_read(spark, tmp_path, capsys):
    texts = LotTexts(spark, str(tmp_path), buckets=16)
    texts.append("lots", spark.createDataFrame([(i, "a", "b", 1, 0) for i in range(200)], LOGS["lots"][0]))
    texts._current("lots", [3]).explain()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", capsys.readouterr().out)


def test_items_of_large_keys_stay_apart(spark, tmp_path):
    from tenderloom.plans import indexed

    d = str(tmp_path)
    spark.createDataFrame([(1, "urgent", "O")], "o_orderkey long, o_orderpriority string, o_orderstatus string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(1, 1000005, 3, 1, 9.0), (1, 5, 3, 2, 9.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame([(5, "bolt"), (1000005, "nut")], "p_partkey long, p_name string").write.parquet(f"{d}/part.parquet")
    assert [r["text"] for r in indexed.refreshed_lots(spark, d).collect()] == ["urgent o bolt nut"]

"""The archive's dossiers: pieces of every lot, with and without a notice, and queries that read them instead of raw lines."""

from tenderloom.operators import history
from tenderloom.plans.archive import Archive
from test_queries import DATA


def test_pieces_of_every_lot(spark):
    lots = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "lot_id long, query_text string")
    part = spark.createDataFrame([(1, 7, True, False), (1, 8, False, True), (9, 7, True, False)], "lot_id long, supplier_inn long, is_winner boolean, label_conflict boolean")
    prod = spark.createDataFrame([(1, "x", "22.1", "22"), (1, "y", None, "unknown"), (1, "z", "22.1", "22"), (8, None, "23", "23"), (None, "n", "24", "24")], "lot_id long, product_name string, okpd2_code string, category string")
    d = history.dossiers(lots, part, prod)
    assert {(r["lot_id"], r["known"], tuple(sorted(r["categories"]))) for r in d.collect()} == {
        (1, True, ("22", "unknown")), (2, True, ("unknown",)), (3, True, ("unknown",)), (8, False, ("23",)), (9, False, ()), (None, False, ("24",))}
    assert sorted(map(tuple, history.bids(d).collect())) == sorted(map(tuple, part.collect()))
    assert sorted(map(str, history.wares(d).collect())) == sorted(map(str, prod.collect()))
    info = {r["lot_id"]: (r["product_count"], r["category_count"], r["participant_count"], r["winner_count"], r["label_conflict"], r["okpd2_codes"]) for r in history.lot_info(d).collect()}
    assert info == {1: (3, 2, 2, 1, True, ["22.1"]), 2: (0, 1, 0, 0, False, []), 3: (0, 1, 0, 0, False, [])}


def test_raw_tables_are_read_for_dossiers_only(spark, capsys):
    a = Archive(spark, DATA)
    for df in (a.cards, a.stats, a.targets, a.customers, history.evidence(a.pairs, a.card_keys, a.dossiers), history.encoder_pairs(a.targets, a.card_keys)):
        df.explain()
        plan = capsys.readouterr().out
        assert "Scan parquet" in plan and "l_orderkey" not in plan and "o_orderkey" not in plan

"""Compact cards: turns, doubles, empty examples, and where products stand."""

import datetime

import pytest

from tenderloom.operators import cards

EX = "supplier_inn long, category string, place int, notice string, items array<struct<name:string,code:string,source_length:int,lot_id:long>>"


def test_turns_doubles_and_nothing(spark):
    item = lambda n, c="": (n, c, len(n), 1)
    rows = [
        (1, "22.40", 1, " Bolts ", [item("bolt", "22.40.1"), item("nut")]), (1, "22.40", 2, "bolts", [item(" BOLT"), item("gear", "2")]), (1, "22.40", 3, "", None),
        (2, "x", 1, "", []), (3, "y", 1, "y", [item("y"), item("  "), item("Y y")]),
    ]
    made = cards.compact(spark.createDataFrame(rows, EX), most=3)
    got = {r["supplier_inn"]: r for r in made.collect()}
    assert got[1]["text"] == "Категория ОКПД2: 22.40. Товары и услуги: bolt (ОКПД2 22.40.1); nut; gear (ОКПД2 2). Примеры закупок: Bolts."
    assert got[2]["text"] == "Категория ОКПД2: x. Недостаточно текстовых примеров." and got[2]["items"] == []
    assert got[3]["text"] == "Категория ОКПД2: y. Товары и услуги: y; Y y. Примеры закупок: y."
    seen = {(r["supplier_inn"], r["name"]): (r["begin"], r["end"], r["seen"]) for r in cards.mentions(made, 50).collect()}
    for (who, name), (a, b, how) in seen.items():
        assert got[who]["text"][a:b] == name
        assert how == ("full" if b <= 50 else "part" if a < 50 else "none")
    assert seen[3, "y"] == (17, 18, "full") and seen[1, "nut"][2] == "none"
    assert cards.compact(spark.createDataFrame([], EX)).count() == 0


def test_examples_are_dealt_once(spark, capsys):
    from tenderloom.plans import cards as queries

    queries.compact_cards(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning(supplier_inn") == 1 and plan.count("Exchange hashpartitioning(lot_id") < 12


def test_items_of_lots_and_busy_suppliers(spark, monkeypatch):
    long = "n" * 200
    wares = [("bolt", "22.40.9", "22.40"), ("bolt", "22.40.1", "22.40"), (long + "a", None, "22.40"), (long + "bb", "x", "22.40"), (None, "31", "31"), *[(f'{k} "q", \\ \n', "1", "44") for k in "gfedcba"]]
    lot = "lot_id long, publish_date date, query_text string, bids array<struct<supplier_inn:long>>, wares array<struct<product_name:string,okpd2_code:string,category:string>>, categories array<string>"
    day = datetime.date
    rows = [
        (1, day(1998, 1, 1), "one", [(5,), (6,)], wares, ["22.40", "31", "44"]), (2, day(1998, 1, 2), "two", [(5,)], [], ["unknown"]),
        (3, day(1998, 1, 3), "two", [(5,)], [], ["unknown"]), (4, day(1998, 1, 4), None, [(5,)], wares[:1], ["22.40"]), (None, day(1998, 1, 4), "x", [(5,)], [], ["unknown"]), (7, day(1998, 1, 4), "x", [], [], ["unknown"]),
    ]
    lots = spark.createDataFrame(rows, lot)
    items = [("bolt", "22.40.1", 4, 1), (long, "", 202, 1)]
    fives = [(f'{k} "q", \\ \n', "1", 10, 1) for k in "abcde"]
    want = [(5, "22.40", 1, "", [("bolt", "22.40.9", 4, 4)], 1), (5, "22.40", 2, "one", items, 1), (5, "31", 1, "one", None, 1), (5, "44", 1, "one", fives, 1), (5, "unknown", 1, "two", None, 2)]
    want += [(6, "22.40", 1, "one", items, 1), (6, "31", 1, "one", None, 1), (6, "44", 1, "one", fives, 1)]
    for most in (100_000, 2):  # the second: supplier 5 is dealt by category
        monkeypatch.setattr(cards, "BUSY", most)
        found = cards.examples(lots)
        got = [(r["supplier_inn"], r["category"], r["place"], r["notice"], r["items"] and [tuple(i) for i in r["items"]], r["lots"]) for r in found.collect()]
        assert sorted(got, key=lambda r: r[:3]) == want
        assert {(r["supplier_inn"], r["category"]): len(r["items"]) for r in cards.compact(found).collect()} == {(a, c): sum(len(r[4] or []) for r in want if r[:2] == (a, c)) - (1 if (a, c) == (5, "22.40") else 0) for a, c, *_ in want}


@pytest.mark.parametrize("name", ["card_examples", "compact_cards", "card_mentions"])
def test_examples_move_few_bytes(spark, capsys, name):
    from tenderloom.plans import cards as queries

    queries.QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_shuffles_of_a_written_table_are_deleted(spark):
    from tenderloom.operators.scratch import Scratch

    known = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = known()
    rows = Scratch(spark, "t").write("t", spark.range(100).repartition(3, "id"))
    assert known() <= before and rows.filter("id >= 0").collect()[99:]

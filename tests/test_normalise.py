"""Names, attributes and queues where SQL says little."""

import pytest
from pyspark.sql import functions as F

from tenderloom.functions import names
from tenderloom.functions import text as t
from tenderloom.operators import queues


def test_names_apart(spark):
    rows = [
        ("Насос  ЦНС ГОСТ Р 123-45 арт. 77-А «Ромашка», 220 В 5,5 мм", "Ромашка"), ("Болт М6 ТУ 14-1, 123456", ""), ("ОПТОМ", ""), (None, None), ("x - ", "x(y"),
    ]
    df = spark.createDataFrame(rows, "name string, brand string")
    noise = ["оптом"]
    got = [r["p"] for r in df.select(names.decompose(F.col("name"), F.col("brand"), F.lit(""), noise=noise).alias("p")).collect()]
    assert (got[0]["article"], got[0]["brand"], got[0]["attributes"]) == ("77-А", "Ромашка", {"gost": "ГОСТ Р 123-45", "voltage_v": "220", "length_mm": "5.5"})
    assert got[0]["core"].startswith("насос цнс") and "ромашка" not in got[0]["core"]
    assert (got[1]["core"], got[1]["article"], got[1]["attributes"]) == ("болт м6", "123456", {"tu": "ТУ 14-1"})
    assert got[2]["core"] == "оптом" and got[3]["core"] == "" and got[4]["core"] == "x"
    key = df.select(names.merge_key(names.decompose(F.col("name"), F.col("brand"), F.lit("")))).first()[0]
    assert key == "ромашка 77-а"


def test_a_name_is_read_once(spark, capsys):
    df = spark.createDataFrame([("Болт М6 ТУ 14-1, 123456", "")], "name string, brand string")
    df.select(names.decompose(F.col("name"), F.col("brand"), F.lit("")).alias("p")).select("p.core", "p.article", names.merge_key(F.col("p"))).explain()
    assert len(capsys.readouterr().out) < 60_000  # an extractor that repeats the text before it doubles the plan


def test_any_brand_leaves_the_name(spark):
    brands = ["a\\Eb", "\\E", "x(y", "[z", "c++", "$1", "Q\\"]
    df = spark.createDataFrame([(b, f"bolt {b} 5") for b in brands], "brand string, name string")
    got = {r["brand"]: r["p"]["core"] for r in df.select("brand", names.decompose(F.col("name"), F.col("brand"), F.lit("")).alias("p")).collect()}
    assert got["a\\Eb"] == "bolt 5" and got["x(y"] == "bolt 5" and len(got) == len(brands)


def test_attributes(spark):
    df = spark.createDataFrame([({" Вес ": "1", "weight": "2", "": "x", "a": " "},), (None,), ({},)], "m map<string,string>")
    got = [r[0] for r in df.select(names.canonical_attributes(F.col("m"), {"вес": "weight"})).collect()]
    assert got[0] in ({"weight": "1"}, {"weight": "2"}) and got[1] is None and got[2] == {}


def test_dates_urls_terms(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert str(one(t.tolerant_date(F.lit(" 1.2.2003")))) == "2003-02-01" and str(one(t.tolerant_date(F.lit("2003-02-01T5")))) == "2003-02-01"
    assert one(t.tolerant_date(F.lit("2003-02-31"))) is None and one(t.tolerant_date(F.lit(""))) is None
    assert one(t.is_web_url(F.lit("HTTPS://a"))) and not one(t.is_web_url(F.lit("http:///a"))) and not one(t.is_web_url(F.lit(None).cast("string")))
    assert one(t.analyze(F.lit("Прошу поставка насосами для THE pumps я 5 42"))) == ["насос", "pump", "42"]
    assert one(t.query_prefixes(F.lit("happy pumps skies dying on я важнейшими ПУМПЫ"))) == ["happ", "pump", "важн", "пумп"]


def test_queue_is_flushed_when_full_or_old():
    assert queues.flush_due(32, 32, None, 0, 60) and queues.flush_due(1, 32, 0, 60, 60)
    assert not queues.flush_due(0, 32, 0, 100, 60) and not queues.flush_due(31, 32, 50, 60, 60)


def test_chunks_fail_alone_and_are_taken_up_again(spark):
    lots = spark.createDataFrame([(i, i == 0) for i in range(8)], "lot_id long, processed boolean")
    saved, waits, tries = {}, [], []

    def work(part):
        ids = {r["lot_id"] for r in part.collect()}
        tries.append(ids)
        if 5 in ids or (1 in ids and len(tries) == 1):
            raise ValueError("no answer")
        return part

    def save(part):
        saved.update({r["lot_id"]: r["failed"] for r in part.collect()})

    assert queues.in_chunks(lots, work, save, chunk=3, wait=waits.append) == 1
    assert saved == {1: False, 2: False, 3: False, 4: True, 5: True, 6: True, 7: False}
    assert waits == [2.0, 2.0, 5.0]


def test_fresh_snapshots_are_kept_and_old_ones_outlive_a_failure(spark):
    stored = spark.sql("SELECT timestamp'2024-01-01 00:00:00' AS as_of, 'old' AS payload")
    new = lambda: stored.withColumn("payload", F.lit("new"))

    def broken():
        raise ValueError("down")

    read = lambda got: (got[0].first()["payload"], got[1])
    assert read(queues.fresh_or(stored, broken, F.lit("2024-01-01 00:14:59"))) == ("old", [])
    assert read(queues.fresh_or(stored, new, F.lit("2024-01-01 00:15:00"))) == ("new", [])
    assert read(queues.fresh_or(stored, broken, F.lit("2024-01-02 00:00:00"))) == ("old", ["refresh_failed"])
    with pytest.raises(ValueError):
        queues.fresh_or(stored.limit(0), broken, F.lit("2024-01-01 00:00:00"))


def test_newest_uploads(spark):
    rows = spark.range(250).select(F.col("id").alias("upload_id"), (F.col("id") % 50).alias("created_at"))
    assert [r["upload_id"] for r in queues.newest(rows, 3).collect()] == [249, 199, 149]

import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenderloom.operators import state
from tenderloom.sources import files, sinks
from tenderloom.streaming import sync


def test_archive_csv(spark, tmp_path):
    p = tmp_path / "suppliers.csv"
    p.write_text("﻿lot_id;supplier_inn;supplier_kpp;is_winner\n1;7707083893;;true\n2;x;;\n", encoding="utf-8")
    df = files.archive_table(spark, str(p), "suppliers")
    assert df.columns == files.ARCHIVE["suppliers"] and df.count() == 2
    with pytest.raises(ValueError):
        files.archive_table(spark, str(p), "products")


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("../x/one.csv", "a")
        z.writestr("two.csv", "b")
    got = files.zip_members(spark, str(tmp_path / "a.zip")).select("name", F.decode("content", "UTF-8").alias("t")).collect()
    assert sorted(map(tuple, got)) == [("one.csv", "a"), ("two.csv", "b")]


def test_notices_in_either_encoding(spark, tmp_path):
    text = "lot_id\tprocedure_name\tstart_price\nл1\tКабель\t1 200,50\nL2\t\t-1\n\t\t\nL3\tТруба\t\nL3\tТруба\t\n"
    for encoding in ("utf-8", "cp1251"):
        p = tmp_path / f"{encoding}.csv"
        p.write_bytes(text.encode(encoding))
        got = {r["lot_id"]: r["issues"] for r in files.checked_notices(files.notice_csv(spark, str(p))).collect()}
        assert got == {"л1": ["lot_id"], "L2": ["title", "start_price"], "L3": ["lot_id_repeated"]}
    with pytest.raises(ValueError):
        files.sniff(b"PK\x03\x04")


def test_items_attach_in_order(spark):
    notices = spark.createDataFrame([("a", "t")], "lot_id string, title string")
    items = spark.createDataFrame([("a", "bolt", "1"), ("a", "bolt", "1"), ("a", "nut ", "2")], "lot_id string, product_name string, okpd2_code string").coalesce(1)
    got = files.attach_items(notices, items).first()["positions"]
    assert [p["name"] for p in got] == ["bolt", "bolt", "nut"] and got[0]["item_id"][:-1] == got[1]["item_id"][:-1] and got[1]["item_id"].endswith("-2")
    with pytest.raises(Exception, match="unknown lot z"):
        files.attach_items(notices, items.withColumn("lot_id", F.lit("z"))).collect()


FEED = """<yml_catalog><shop><categories><category id="1">Tools</category></categories><offers>
<offer id="7" available="false"><name>Saw</name><price>10,5</price><categoryId>1</categoryId><param name="Size">3</param></offer>
<offer><url>http://u</url><typePrefix>Big</typePrefix><vendor>Acme</vendor><model>X</model><price>-1</price></offer>
<offer><name>nothing</name></offer></offers></shop></yml_catalog>"""


def test_product_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    got = {r["name"]: r for r in files.product_feed(spark, str(tmp_path / "feed.xml")).collect()}
    assert set(got) == {"Saw", "Big Acme X"}
    assert (got["Saw"]["external_id"], float(got["Saw"]["price"]), got["Saw"]["source_category"], got["Saw"]["availability"], got["Saw"]["attributes"]) == ("7", 10.5, "Tools", "on_order", {"Size": "3"})
    assert got["Big Acme X"]["price"] is None and got["Big Acme X"]["external_id"].startswith("http://u#")


def test_registry_dump(spark, tmp_path):
    (tmp_path / "r.xml").write_text('<f><doc inn="1" day="02.01.2024" main="" rep="46.1" reg="7"/><doc inn="" day="2024-01-02" main="1" rep="" reg="77"/><doc inn="2" day="2024-01-03" main="10" rep="11" reg="78"/></f>')
    schema = T.StructType([T.StructField(f"_{n}", T.StringType()) for n in ("inn", "day", "main", "rep", "reg")])
    got = files.registry_dump(spark, str(tmp_path / "r.xml"), "doc", {"inn": "_inn", "registry_date": "_day", "main_okved": "_main", "reported_okved": "_rep", "region": "_reg"}, schema)
    assert sorted((r["inn"], str(r["registry_date"]), r["okved"], r["okved_reported"], r["region"]) for r in got.collect()) == [("1", "2024-01-02", "46.1", True, "07"), ("2", "2024-01-03", "10", False, "78")]


def test_page_products(spark):
    page = '<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"Saw","brand":{"name":"A"},"offers":{"price":"5","availability":"https://schema.org/InStock"}},{"@type":"Thing"}]}</script><script type="application/ld+json">{x</script><script type="application/ld+json">[{"@type":"Offer","name":"Nut","price":2}]</script>'
    got = files.page_products(spark.createDataFrame([("u", page), ("v", None)], "url string, html string")).collect()
    assert sorted((r["name"], r["brand"], float(r["price"]), r["availability"]) for r in got) == [("Nut", "", 2.0, ""), ("Saw", "A", 5.0, "InStock")]


def test_sampling_is_balanced(spark):
    rows = [(f"u{i}", "r", "ab"[i > 3], i) for i in range(6)] + [("u0", "q", "z", 9), ("w", "q", "z", 10)]
    got = files.balanced_sample(spark.createDataFrame(rows, "url string, root string, subcategory string, ordinal int"), 3).collect()
    assert sorted(r["url"] for r in got) == ["u0", "u1", "u4", "w"]


def test_imports_can_be_repeated(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for _ in range(2):
        assert sinks.verified_import(df, str(tmp_path / "t"), "id", {"n": F.count("*") == 2}).count() == 2
    with pytest.raises(ValueError):
        sinks.verified_import(df, str(tmp_path / "t"), "id", {"n": F.count("*") == 3})
    for _ in range(2):
        assert sinks.import_archive({"t": (df, "id")}, str(tmp_path / "a"), "s1").count() == 1
    with pytest.raises(ValueError):
        sinks.import_archive({"t": (df.limit(1), "id")}, str(tmp_path / "a"), "s1")


def test_runs_publish_whole_or_not(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    at = F.lit(datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        sinks.publish_run(df, str(tmp_path), "r0", "id", 3, at)
    sinks.publish_run(df, str(tmp_path), "r1", "id", 2, at)
    assert [r["run_id"] for r in spark.read.parquet(str(tmp_path / "published")).collect()] == ["r1"]


def test_snapshots_and_retirement(spark):
    df = spark.createDataFrame([(1, "x")], "n int, k string")
    s = sinks.snapshot(df, "all", 2, F.lit(datetime(2024, 1, 1)))
    assert sinks.latest_snapshot(s.unionByName(s), 2).first()["payload"] == '[{"n":1,"k":"x"}]'
    r = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-02-01")], "inn int, registry_date string")
    assert [x["inn"] for x in sinks.retire(r).collect()] == [2]


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    rows = [(i, datetime(2024, 1, 1, i % 5), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, at timestamp, value double")
    df.write.parquet(str(src))
    df.limit(5).write.mode("append").parquet(str(src))
    for _ in range(2):  # a second start finds nothing new
        stream = sync.once_per_key(sync.landed(spark, str(src), df.schema, 2), "id", "at", "2 days")
        sync.sync(stream, lambda b: b.withColumn("double", F.col("value") * 2), out, str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 10 and got.agg(F.sum("double")).first()[0] == 90.0
    windows = sync.counts_by_window(sync.landed(spark, str(src), df.schema), "at", "1 hour", "1 minute")
    q = windows.writeStream.outputMode("append").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() == 3


def test_finish_only_after_a_full_pass(spark):
    at = lambda d: datetime(2024, 1, d)
    v = spark.createDataFrame([(1, "s", at(1), "available", 1, 0), (2, "s", at(9), "available", 2, 0)], "id int, source string, updated_at timestamp, availability string, version long, is_deleted int")
    done = lambda ok, day: [r["id"] for r in sync.finish(v, ["id"], F.col("source") == "s", F.lit(at(day)), ok).collect()]
    assert done(True, 5) == [1] and done(False, 5) == [] and done(True, 20) == []


def test_readers_by_key_and_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "name": "x"}\n\n{"id": 2, "name": "y"}\n')
    (tmp_path / "b.json").write_text('{\n"id": 3,\n"name": "z"\n}')
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])
    rows = files.json_lines(spark, str(tmp_path / "a.jsonl"), schema)
    assert sorted(map(tuple, rows.collect())) == [(1, "x"), (2, "y")]
    assert tuple(files.dictionary(spark, str(tmp_path / "b.json"), schema).first()) == (3, "z")
    assert [r["name"] for r in files.by_keys(rows, spark.createDataFrame([(2,), (2,), (9,)], "id long"), ["id"]).collect()] == ["y"]
    (tmp_path / "c.jsonl").write_text('{"id": 1\n')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        files.json_lines(spark, str(tmp_path / "c.jsonl"), schema).collect()


def test_companies_and_eligible_lots(spark):
    df = spark.createDataFrame([("7707083893",), (" 7707083893 ",), ("123",), (None,)], "inn string")
    assert [r["inn"] for r in files.supplier_dataset(df).collect()] == ["7707083893"]
    lots = spark.sql("SELECT * FROM VALUES (1, date'2020-01-01', false), (2, date'2020-01-01', true), (3, date'2021-01-01', false) AS t(lot_id, publish_date, notice_conflict)")
    assert [r["lot_id"] for r in files.eligible(lots, F.lit("2020-06-01").cast("date")).collect()] == [1]


def test_exports_journal_and_derived_values(spark, tmp_path):
    lots = spark.sql("SELECT 1 AS lot_id, 't' AS title, array(named_struct('inn', '7', 'name', 'a', 'score', 0.5D, 'shortlisted', true), named_struct('inn', '8', 'name', 'b', 'score', 0.4D, 'shortlisted', false)) AS candidates")
    assert [tuple(r) for r in sinks.product_lines(lots).collect()] == [(1, "t", "7", "a", 0.5)]
    runs = spark.sql("SELECT 5 AS run_id, timestamp'2020-01-01 00:00:00' AS started_at")
    for _ in range(2):
        sinks.run_journal(runs, str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).distinct().count() == 1
    row = spark.createDataFrame([("", "1", "b", "c", None, "d", "", "")], "classified_code string, source_code string, normalized_brand string, source_brand string, normalized_article string, source_article string, normalized_currency string, source_currency string")
    assert tuple(row.select(*[c.alias(n) for n, c in state.derived_values().items()]).first()) == ("1", "b", "d", "")
    codes = spark.createDataFrame([("gold", "1"), ("none", "2"), ("archive", "3")], "m string, c string")
    assert [r[0] for r in codes.select(state.source_code(F.col("m"), F.col("c"))).collect()] == ["1", "2", ""]


def test_a_snapshot_is_no_table(spark):
    at = F.lit("2020-01-01").cast("timestamp")
    assert sinks.snapshot(spark.range(3), "s", 1, at, most=3).first()["payload"] == '[{"id":0},{"id":1},{"id":2}]'
    with pytest.raises(Exception, match="not a table"):
        sinks.snapshot(spark.range(4), "s", 1, at, most=3).collect()

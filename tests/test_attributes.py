"""Attributes: each value is tidied once, however often its map is looked into, and on all cores."""

import os

from pyspark.sql import functions as F

from tenderloom.functions import names
from tenderloom.plans import normalise


def test_values_are_tidied_once(spark):
    source = F.create_map(F.lit("Размер"), F.col("a"), F.lit("size"), F.lit("2"), F.lit("вес"), F.col("b"))
    one = spark.createDataFrame([("янв.79", " "), ("10.ИЮН  x", None), ("Мая", "5")], "a string, b string")
    rows = one.select(names.merge_attributes(F.create_map(F.lit("size"), F.lit("0"), F.lit("brand"), F.lit("B")), names.canonical_attributes(source, {"размер": "size"})).alias("m"))
    assert [x["m"] for x in rows.collect()] == [{"size": "1.79", "brand": "B"}, {"size": "10.6 x", "brand": "B"}, {"size": "Мая", "вес": "5", "brand": "B"}]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("янв") <= 3  # a look whether any month is there, and a pattern before and after a number


def test_parts_of_one_file_are_spread(spark, tmp_path):
    os.makedirs(tmp_path / "d")
    spark.range(1, 41).selectExpr("id AS p_partkey", "concat('red ', id) AS p_name", "'B' AS p_brand", "cast(id AS int) AS p_size").coalesce(1).write.parquet(str(tmp_path / "d/part.parquet"))
    out = normalise.attributes_merged(spark, str(tmp_path / "d"))
    assert out.rdd.getNumPartitions() > 1 and out.filter("p_partkey = 7").first()["attributes"] == "brand=B;size=7 mm;цвет=red"

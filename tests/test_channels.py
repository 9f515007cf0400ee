"""Channels over every matching part and lot: what the 501st has counts too."""

import pytest

from tenderloom.plans import register

N = 501


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """``N`` parts and lots that match alike; the last is the only one of supplier 2, and its name comes twice in its lot."""
    d = str(tmp_path_factory.mktemp("many"))
    part = spark.range(N + 1).selectExpr("least(id, 500) + int(id > 500) * 9 AS p_partkey", "if(id < 500, 'blue red', 'gears red') AS p_name", "'Brand#1' AS p_brand", "11 AS p_size", "'x' AS p_type")
    part.write.parquet(f"{d}/part.parquet")
    line = spark.range(N + 1).selectExpr(
        "least(id, 500) AS l_orderkey", "least(id, 500) + int(id > 500) * 9 AS l_partkey", "if(id < 500, 1L, 2L) AS l_suppkey", "1 AS l_linenumber", "1d AS l_quantity", "9d AS l_extendedprice",
        "0.05d AS l_discount", "0.01d AS l_tax", "'N' AS l_returnflag", "'F' AS l_linestatus", "timestamp '1998-01-01' AS l_shipdate",
    )
    line.write.parquet(f"{d}/lineitem.parquet")
    return d


def against_sql(name, d, got):
    import duckdb
    from test_queries import DATA, TABLES, rows

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{f'{d}/{t}.parquet/*.parquet' if t in ('part', 'lineitem') else f'{DATA}/{t}.parquet'}'")
    assert rows(got) == rows(c.sql(register.SQL[name]).df())


def test_ranks_of_every_match(spark, many):
    got = register.QUERIES["channel_ranks"](spark, many).toPandas()
    assert sorted(got[["channel", "supplier_id", "rank"]].itertuples(index=False, name=None)) == [("history", 1, 2), ("history", 2, 1), ("lexical", 1, 2), ("lexical", 2, 1)]
    against_sql("channel_ranks", many, got)


def test_fusion_of_every_match(spark, many):
    got = register.QUERIES["rrf_weighted"](spark, many).toPandas()
    assert dict(zip(got["supplier_id"], got["raw"], strict=True)) == {1: round(2 / 62 + 0.5 / 61, 9), 2: round(2 / 61 + 0.5 / 62, 9)}
    against_sql("rrf_weighted", many, got)

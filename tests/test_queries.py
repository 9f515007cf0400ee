"""Every registered query of the engine's own operators against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from tenderloom.plans import register

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(x):
    if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
        return None
    if isinstance(x, float) and x == int(x):
        return str(int(x))
    return repr(x) if isinstance(x, float) else str(x)


def rows(df):
    return sorted(map(str, zip(*[[cell(x) for x in df[c].tolist()] for c in sorted(df.columns)], strict=True)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(register.QUERIES))
def test_query(spark, duck, name):
    got = register.QUERIES[name](spark, DATA).toPandas()
    if name in register.SQL:
        want = duck.sql(register.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(register.QUERIES) <= set(e.queries())

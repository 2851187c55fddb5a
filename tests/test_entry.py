import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from corvellum.plans import catalog


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "id", "rank", "score"] and df.count() > 0


@pytest.fixture(scope="module")
def tables():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck(tables):
    con = duckdb.connect()
    for path in glob.glob(f"{tables}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    return round(float(v), 6) if isinstance(v, int | float | bool) or hasattr(v, "dtype") and v.dtype.kind in "iufb" else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(repr([plain(v) for v in r]) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, tables, name):
    assert rows(catalog.queries()[name](spark, tables).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql(spark, tables, name):
    assert catalog.queries()[name](spark, tables).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from trackloom.plans.queries import queries

CORE = [n for n in queries()]
SQL = entry.oracle_sql()


def plain(df, cols):
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v) or v is pd.NaT:
            return "~"
        return str(v) if isinstance(v, (str, bool)) or type(v).__name__ == "bool" else repr(round(float(v), 6))

    return sorted(tuple(map(one, r)) for r in df[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, data, db, name):
    got = queries()[name](spark, data).toPandas()
    if name in SQL:
        want = db.execute(SQL[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert plain(got, cols) == plain(want, cols)


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0

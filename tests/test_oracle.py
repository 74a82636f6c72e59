"""Each query against its DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from gridmend.plans.oracle import SQL
from gridmend.plans.queries import QUERIES

DIR = "/root/testdata/sf0.001"


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)

    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or v != v:
            return ""
        return repr(round(float(v), 6)) if not isinstance(v, str) else v

    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    mine, want = QUERIES[name](spark, DIR).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(mine.columns) == sorted(want.columns)
    assert rows(mine) == rows(want)


def test_every_query_is_listed():
    assert set(SQL) <= set(QUERIES)

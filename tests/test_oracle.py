"""Every query of the core against its SQL on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from pagelake.plans import catalog


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, data, sql, name):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    mine = Counter(tuple(str(r[c]) for c in cols) for r in df.collect())
    got = sql.execute(catalog.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = Counter(tuple(str(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert mine == theirs


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)

"""Every query of the subpackage that has SQL, against it."""

import glob
import os

import duckdb
import pytest

from pagelake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, data, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, data)
    got = con.execute(queries.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == sorted(str(list(r)) for r in got.fetchall())

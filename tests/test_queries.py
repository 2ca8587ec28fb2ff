"""Each query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from orogen.plans.oracles import ORACLES
from orogen.plans.queries import QUERIES


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got = con.execute(ORACLES[name])
    names = [d[0] for d in got.description]
    want = sorted((tuple(dict(zip(names, r))[c] for c in cols) for r in got.fetchall()), key=repr)
    assert sorted(names) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == want

"""Every query of the catalog against its SQL on DuckDB, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from weftline.plans.catalog import oracle_sql, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(float(f"{r[i]:.12g}") if isinstance(r[i], float) else r[i] for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, DATA)
    got = duck.execute(oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())

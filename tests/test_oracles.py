"""Every registered search query against its DuckDB SQL, over whole tables."""

import glob
import os

import duckdb
import pytest

from sparklex.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    expected = tables.execute(ORACLES[name])
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical([d[0] for d in expected.description], expected.fetchall())

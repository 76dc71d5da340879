"""Queries with SQL give the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from lumora.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got = queries.QUERIES[name](spark, SF)
    want = c.execute(queries.oracle_sql()[name])
    names = sorted(d[0] for d in want.description)
    assert sorted(got.columns) == names
    assert sorted(map(tuple, got.select(names).collect())) == sorted(tuple(r) for r in want.df()[names].itertuples(index=False))

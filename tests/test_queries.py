"""Every query with SQL gives the rows that DuckDB gives; those of the training-data subpackage are tested in tests/llm."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lumora import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    def cell(x):
        if pd.isna(x):
            return None
        return round(float(x), 6) if isinstance(x, int | float) or hasattr(x, "item") else str(x)

    return sorted(repr(tuple(cell(x) for x in r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_equals_sql(spark, duck, name):
    got = plans.QUERIES[name](spark, SF).toPandas()
    if name in plans.SQL:
        want = duck.execute(plans.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)

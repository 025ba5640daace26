"""Every query against the SQL that states the same, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from threadloom.plans.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(df, columns):
    one = lambda v: "" if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, float) and v.is_integer() else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(one, r)) for r in df[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["root_id", "score", "matched", "best"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

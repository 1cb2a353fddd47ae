"""Every registered query equals its DuckDB oracle on the sf0.001 tables."""

import os
import sys

import duckdb
import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import TABLES, digest  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    got = digest(E.queries()[name](spark, SF).toPandas())
    exp = digest(con.sql(E.oracle_sql()[name]).df())
    assert got[0] == exp[0], (got[0], exp[0])
    assert got[1] == exp[1]
    assert got[2] == exp[2], (set(got[3]) ^ set(exp[3]))


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "Level_0" in df.columns

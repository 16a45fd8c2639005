"""The driver contract: queries against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry_points

DATA = "/root/testdata/sf0.001"
TABLES = "customer documents embeddings events orders supplier".split()
CORE = sorted(entry_points.catalog.ORACLES)

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@needs_data
@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, duck, name):
    own, want = entry_points.queries()[name](spark, DATA).toPandas(), duck.sql(entry_points.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(own.columns) == columns
    rows = lambda f: f[columns].sort_values(columns).reset_index(drop=True)
    import pandas as pd

    pd.testing.assert_frame_equal(rows(own), rows(want), check_dtype=False, check_exact=True)


@needs_data
@pytest.mark.parametrize("name", sorted(set(entry_points.catalog.QUERIES) - set(CORE)))
def test_query_without_sql_has_rows(spark, name):
    rows = entry_points.queries()[name](spark, DATA).collect()
    assert rows
    if "recall" in rows[0].asDict():
        assert rows[0]["recall"] >= 0.95


@needs_data
def test_entry(spark):
    assert entry_points.entry(spark).count() == 5000


def test_names():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quern.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as from '{f}'")
    return c


def rows(df, columns):
    return df[columns].astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_and_sql_agree(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) > 0
    assert rows(got, columns).equals(rows(want, columns))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())

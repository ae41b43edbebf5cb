"""Every registered query against its SQL twin on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as driver  # noqa: E402
from palimpsest.plans import catalog  # noqa: E402
from tools.compare import TABLES, plain  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.QUERIES, catalog.ORACLES


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)


def test_the_driver_sees_every_query():
    assert set(QUERIES) <= set(driver.queries())
    assert set(ORACLES) <= set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).columns[0] == "candidate_id"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    frame = con.sql(ORACLES[name])
    assert sorted(frame.columns) == columns
    index = [frame.columns.index(c) for c in columns]
    got = sorted(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    assert got == sorted(tuple(plain(row[i]) for i in index) for row in frame.fetchall())

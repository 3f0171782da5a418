"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from oracles.sql import leftover_sql

FOLDER = os.environ.get("RECON_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _plain(rows):
    return sorted(repr([float(v) if type(v).__name__ in ("Decimal", "float") else v for v in row]) for row in rows)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = df.select(*columns).collect()
    if name not in entry.oracle_sql():
        assert got
        return
    want = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert _plain(got) == _plain([[row[i] for i in order] for row in want.fetchall()])


@pytest.mark.parametrize("name", sorted(leftover_sql()))
def test_unrolled_rounds_suffice(duck, name):
    assert duck.execute(leftover_sql()[name]).fetchall() == [(0,)]

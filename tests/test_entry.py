import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = sorted(k for k in entry.oracle_sql() if not k.startswith("op") and k != "pipeline")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, oracle, name):
    df = entry.queries()[name](spark, DATA)
    cursor = oracle.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    expected = sorted(map(repr, cursor.fetchall()))
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_is_callable():
    assert all(map(callable, entry.queries().values())) and set(entry.oracle_sql()) <= set(entry.queries())

"""The driver's contract: names, columns, and results of all queries against DuckDB on the smallest tables; growth with the tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
REGISTRY = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", REGISTRY)
def test_against_duckdb(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = sorted((tuple(plain(r[columns.index(c)]) for c in names) for r in result.fetchall()), key=repr)
    assert sorted(columns) == names and got == want


def test_every_query_of_the_registry_has_an_oracle():
    assert set(REGISTRY) == {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() == 5

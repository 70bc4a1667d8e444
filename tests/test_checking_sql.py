"""Every query with checking SQL gives the same rows as DuckDB on the given tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from caudal.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


@pytest.fixture(scope="module")
def checker():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def ordered(rows):
    return sorted((tuple(map(str, r)) for r in rows))


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_same_rows(spark, checker, name):
    df = driver.queries()[name](spark, SF)
    answer = checker.execute(driver.oracle_sql()[name])
    assert [c[0] for c in answer.description] == df.columns
    assert ordered(df.collect()) == ordered(answer.fetchall())


def test_entry(spark):
    assert driver.entry(spark).count() == 10

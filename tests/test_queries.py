"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tallystream.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, oracle, name):
    found = QUERIES[name](spark, FOLDER)
    wanted = oracle.sql(SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    place = [wanted.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[k]) for k in place) for r in wanted.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 16


def test_every_command_counts(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    rows = QUERIES["transaction_status"](spark, FOLDER).collect()
    assert sum(r.records for r in rows) == events.filter("event_type NOT IN ('purchase', 'error')").count()
    assert {r.status for r in rows} == {"committed", "aborted", "pending"}

"""Every registered query against its SQL, on the smallest data set; queries without SQL by invariants."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, close_to

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert close_to(got, want), f"{len(got)} rows against {len(want)}"


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).limit(1).count() == 1


def test_touched_month_is_replaced_whole(spark, sf):
    d = {r["symbol"]: r for r in QUERIES["a2_write_bars"](spark, sf).collect()}
    assert {r["n_rows"] for r in d.values()} == {30}
    n = spark.read.parquet(f"{sf}/events.parquet").filter("event_type = 'click'").count()
    assert d["click"]["volume"] == 2 * n


def test_flagship(spark):
    assert entry.entry(spark).count() == 5

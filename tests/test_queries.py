"""Every registered query of the log engine, against its SQL in DuckDB."""

from __future__ import annotations

import duckdb
import pytest

from emberlog.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in found.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_entry_adds_what_there_is(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() >= 1

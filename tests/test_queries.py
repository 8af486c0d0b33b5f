"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from ledgerloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(value):
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    return str(value)[:19] if hasattr(value, "isoformat") else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    found = catalogue.QUERIES[name](spark, DATA)
    wanted = con.sql(catalogue.ORACLES[name])
    assert sorted(found.columns) == sorted(wanted.columns)
    columns = sorted(found.columns)
    ours = sorted(repr([plain(r[c]).__str__() for c in columns]) for r in found.collect())
    theirs = sorted(repr([plain(dict(zip(wanted.columns, r))[c]).__str__() for c in columns]) for r in wanted.fetchall())
    assert [x.replace(" 00:00:00", "") for x in ours] == [x.replace(" 00:00:00", "") for x in theirs]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_other_queries_return_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_entry_imports_and_lists():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())

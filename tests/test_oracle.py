"""Every registered query against its SQL, on the smallest given tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import pytest

import __spark_entry__ as entry
from paperloom_checks.queries import QUERIES
from paperloom_checks.sql import SQL

duckdb = pytest.importorskip("duckdb")
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


def as_counter(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else round(value, 9) + 0.0
        return value

    return Counter(tuple(plain(record[i]) for i in order) for record in records)


def test_every_query_has_sql():
    """All of the library's own; the training-data part tests what SQL cannot express."""
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, tables, key):
    frame = entry.queries()[key](spark, SF_DIR)
    mine = as_counter(frame.columns, frame.collect())
    cursor = tables.execute(entry.oracle_sql()[key])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    theirs = as_counter(columns, cursor.fetchall())
    assert mine == theirs
    assert sum(mine.values()) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

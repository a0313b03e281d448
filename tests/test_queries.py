"""Every query with SQL gives the same rows in DuckDB; every other one gives rows (operators without SQL are tested against brute force elsewhere)."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import differences, views

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


#: Queries that find nothing in the smallest data: its legacy bodies have no interactions.
EMPTY = {"payload_interactions"}


@pytest.fixture(scope="module")
def con():
    return views(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    if name in SQL:
        assert differences(df, con, SQL[name]) == ""
    else:
        rows = df.count()
        assert rows == 0 if name in EMPTY else rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

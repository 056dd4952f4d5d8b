"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tools import check  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return check.duck(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, con, sf, name):
    state, note, _, _ = check.compare(spark, con, name, sf)
    assert state in ("ok", "rows"), note


def test_entry_is_lazy_and_has_rows(spark):
    assert entry.entry(spark).count() == 3


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

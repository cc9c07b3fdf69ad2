"""Every query with SQL gives the rows that DuckDB gives; the others run and keep their schema."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import SF, assert_same
from motionspark import plans


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert plans.FLAGSHIP in entry.queries()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, name):
    assert_same(entry.queries()[name](spark, SF), plans.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0

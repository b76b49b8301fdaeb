"""Every core query with SQL gives the same rows as the SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA
from tests.differential import compare
from textloom.plans.oracle import oracle_sql
from textloom.plans.queries import queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, name):
    compare(spark, queries()[name], oracle_sql()[name], DATA)


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query beside its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as registered  # noqa: I001
from tests.compare import compare, duck

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registered.queries(), registered.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, FOLDER, name, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert registered.entry(spark).count() > 0

"""Every registered query that has SQL gives the same rows as the SQL."""

import re

import pytest
from oracle import connect, difference

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_registry():
    assert set(SQL) <= set(QUERIES)
    own = {name for name in QUERIES if name != "pipeline" and not re.match(r"op\d+_", name)}
    assert own - set(SQL) == {"train_cascade", "train_language_identifier"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, con, name):
    assert difference(spark, con, FOLDER, QUERIES[name], SQL[name]) is None


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0

"""Every registered query with SQL must equal DuckDB on the given tables."""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, con, name):
    problem = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert not problem, problem


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["series_id", "model", "rank"]
    assert df.count() == 9

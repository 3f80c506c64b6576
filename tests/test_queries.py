"""Every registered query against its SQL, on the smallest data set."""

import os

import pytest

from __spark_entry__ import SMALLEST, entry, oracle_sql, queries
from tools.check_queries import compare, connect

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return connect(SMALLEST)


def test_entry_has_rows(spark):
    df = entry(spark)
    assert df.columns == ["start_source", "stop_source", "id", "text"] and df.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("key", sorted(queries()))
def test_query(spark, con, key):
    text, good = compare(spark, con, key, queries()[key], oracle_sql().get(key), SMALLEST)
    assert good, text

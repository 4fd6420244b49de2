"""Every registered query against its SQL twin on the smallest data folder."""

import pytest

from gustfront.catalog.load import registered, twins
from tests.harness import compare, connect

FOLDER = "/root/testdata/sf0.001"
RUNS, SQL = registered(), twins()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_query_equals_twin(spark, con, name):
    assert name in SQL, "every query has a twin"
    compare(spark, FOLDER, RUNS[name], SQL[name], con)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0

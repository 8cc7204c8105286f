"""Every registered query next to its SQL equivalent, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        problems, _ = compare(df, duck, ORACLES[name])
        assert not problems
    else:
        assert df.count() > 0


def test_entry(spark):
    assert contract.entry(spark).count() == 4


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

"""Every query that has oracle SQL gives the oracle's rows; the others give rows of a stable schema."""

import oracle
import pytest
from conftest import DATA
from millrace.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(SQL))
def test_agrees_with_the_oracle(spark, con, name):
    assert oracle.difference(spark, con, DATA, QUERIES[name], SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    df = QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0

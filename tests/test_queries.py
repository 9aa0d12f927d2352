import pytest
from oracle import SMALL, connect, same

import __spark_entry__
from tidemark.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, db, name):
    same(QUERIES[name](spark, SMALL), db, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

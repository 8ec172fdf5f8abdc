import pytest

from tests.compare import assert_same, connect
from wayloom.plans.oracles import ORACLES
from wayloom.plans.queries import REGISTRY


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(REGISTRY)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert_same(REGISTRY[name](spark, sf_dir), con, ORACLES[name])

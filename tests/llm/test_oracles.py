import pytest

from tests.compare import assert_same, connect
from wayloom.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    assert_same(queries()[name](spark, sf_dir), connect(sf_dir), oracle_sql()[name])

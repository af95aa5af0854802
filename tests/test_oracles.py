import pytest

from deskmill.plans.registry import ORACLES, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    compare(QUERIES[name](spark, SF), SF, ORACLES[name])

import pytest
from tests.oracle import same

from quillmat.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, small, name):
    same(QUERIES[name](spark, small), ORACLES[name], small)


def test_every_query_is_registered():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"coarse_order", "reorder_plan"}

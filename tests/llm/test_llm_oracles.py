"""Every query of the subpackage that has SQL against it, on the smallest tables."""

import pytest

from steploom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, data, same, name):
    same(QUERIES[name](spark, data), ORACLES[name])

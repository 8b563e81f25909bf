"""Every registered core query against its SQL twin on the smallest tables."""

import pytest

from steploom.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, same, name):
    df = QUERIES[name](spark, data)
    if name in ORACLES:
        same(df, ORACLES[name])
    else:
        assert df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)

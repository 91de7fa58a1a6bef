"""Every query beside its SQL check, on the smallest tables."""

import pytest
from check import compare, oracle

from sheafline.plans.catalog import CHECKS, QUERIES

@pytest.fixture(scope="module")
def con(sf):
    return oracle(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    ok, note = compare(spark, con, sf, name, QUERIES[name], CHECKS.get(name))
    assert ok, note


def test_contract(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0

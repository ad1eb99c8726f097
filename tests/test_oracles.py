"""Every query with SQL gives the same rows as the SQL on DuckDB; the others run."""

import pytest

from quern.plans.registry import ORACLES, QUERIES
from tests.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    assert not differences(spark, QUERIES[name], ORACLES[name], SF)[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0

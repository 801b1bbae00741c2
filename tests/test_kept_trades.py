"""Queries whose trades serve as rows and as legs make them once."""

import pytest

from optlattice.plans import catalog


@pytest.mark.parametrize("name", ["chart_overlay", "pnl_violations"])
def test_trades_are_not_made_again_for_each_leg(spark, sf_dir, name):
    """Made three times, their sorts and hash maps lay in one task at once."""
    out = catalog.QUERIES[name](spark, sf_dir)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan and out.count() > 0

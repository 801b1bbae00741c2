"""All flags and all backtests against brute force."""

import math
from collections import defaultdict
from statistics import NormalDist

import pytest

from optlattice.plans import catalog, fixtures, queries_market


@pytest.fixture(scope="module")
def gaps(spark, sf_dir):
    """Differences above the limit of each instrument, from Black-76 deltas at the stored volatility and a rate of 1 %."""
    b, g = queries_market._bad(spark, sf_dir)
    spot = {(r.instrument_id, r.ts_event): r.close for r in fixtures.underlying_bars(spark, sf_dir).collect()}
    option = {(r.instrument_id, r.ts_event): r for r in b.collect()}
    found = defaultdict(list)
    for r in g.collect():
        o = option.get((r.instrument_id, r.ts_event))
        s = spot.get((r.underlying_id, r.ts_event))
        if o is None or s is None or math.isnan(r.iv):
            continue
        d1 = (math.log(s / o.strike_price) + r.iv**2 / 2 * r.T) / (r.iv * math.sqrt(r.T))
        gap = abs(r.delta - math.exp(-0.01 * r.T) * (NormalDist().cdf(d1) - (o.right == "P")))
        if gap > 0.1:
            found[r.instrument_id].append(gap)
    return found


def test_inconsistent_deltas_of_all_instruments(spark, sf_dir, gaps):
    got = {r.instrument_id: (r.n, r.largest) for r in catalog.QUERIES["audit_delta_whole"](spark, sf_dir).collect()}
    assert {i: n for i, (n, _) in got.items()} == {i: len(x) for i, x in gaps.items()}
    assert all(got[i][1] == pytest.approx(max(x), abs=1e-3) for i, x in gaps.items()) and any(i % 14 in (2, 4) for i in got)


def test_counts_of_all_flags(spark, sf_dir, gaps):
    got = {r.flag_code: (r.n, r.n_instruments) for r in catalog.QUERIES["audit_flag_counts_whole"](spark, sf_dir).collect()}
    assert got["DELTA_INCONSISTENT"] == (sum(map(len, gaps.values())), len(gaps))
    assert got == {r.flag_code: (r.n, r.n_instruments) for r in catalog.QUERIES["audit_flag_counts"](spark, sf_dir).collect()}


def test_heatmap_of_all_backtests(spark, sf_dir):
    total = defaultdict(float)
    for r in fixtures.trades(spark, sf_dir).collect():
        total[r.backtest_id] += r.net_pnl
    got = {r.y: (r["0"], r["1"]) for r in catalog.QUERIES["heatmap_whole"](spark, sf_dir).collect()}
    assert got == {y: (pytest.approx(total[2 * y], abs=1e-3), pytest.approx(total[2 * y + 1], abs=1e-3)) for y in range(4)}

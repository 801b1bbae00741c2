"""Queries that give a whole series give each of its rows, not sums of them."""

from optlattice.operators import exit
from optlattice.plans import catalog, fixtures, queries_backtest


def test_every_greek_has_its_row(spark, sf_dir):
    want = {(r.instrument_id, str(r.ts_event)) for r in fixtures.option_greeks(spark, sf_dir).where("T > 0").collect()}
    rows = catalog.QUERIES["greeks_with_bars"](spark, sf_dir).collect()
    assert len(rows) == len(want) and {(r.instrument_id, r.ts_event) for r in rows} == want


def test_every_bar_of_a_position_has_its_vega(spark, sf_dir):
    found = exit.spread_vega(queries_backtest._entries(spark, sf_dir), fixtures.option_greeks(spark, sf_dir).where("T > 0"))
    want = {(r.entry_id, str(r.ts_event)): r.spread_vega for r in found.collect()}
    for name in ("spread_vega", "spread_vega_whole"):
        rows = catalog.QUERIES[name](spark, sf_dir).collect()
        assert len(rows) == len(want) and all(abs(want[r.entry_id, r.ts_event] - r.spread_vega) < 1e-4 for r in rows)

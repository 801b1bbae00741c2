"""Stored results of runs: ids that go on, legs and continuations by position."""

from pyspark.sql import functions as F

from optlattice.plans import backtest, strategy
from optlattice.sources import results
from test_plans import SPREAD, TRADE, market  # noqa: F401


def test_runs_are_stored_with_ids_that_go_on(spark, market, tmp_path):  # noqa: F811
    data = strategy.load_strategy(SPREAD)
    for path, value in ((TRADE + "exit.stop_loss", 0.5), (TRADE + "exit.on_sl_long_continuation", True), (TRADE + "exit.long_trailing_stop_pct", 0.4)):
        strategy.override(data, path, value)
    closed = backtest.run(strategy.parse_strategy(data), market).cache()
    wanted = closed.orderBy("entry_time").collect()
    root = f"{tmp_path}/results"
    lived = sum(r.continuation_exit_time is not None for r in wanted)
    for k in (1, 2):
        assert results.store_run(closed.withColumn("backtest_id", F.lit(k)), root) == {"position": len(wanted), "position_leg": 2 * len(wanted), "position_continuation": lived}
    n, tables = len(wanted), {t: results.read(spark, root, t).orderBy("id").collect() for t in ("position", "position_leg", "position_continuation")}
    assert all([r.id for r in t] == list(range(1, len(t) + 1)) for t in tables.values())
    for p in tables["position"]:
        r = wanted[(p.id - 1) % n]
        assert (p.backtest_id, p.open_time, p.exit_time, p.net_pnl) == (1 + (p.id - 1) // n, r.entry_time, r.exit_time, r.net_pnl)
    for leg in tables["position_leg"]:
        r = wanted[(leg.position_id - 1) % n].legs[(leg.id - 1) % 2]
        assert (leg.leg_name, leg.instrument_id, leg.quantity, leg.open_price) == (r.leg_name, r.instrument_id, abs(r.signed_qty), r.close) and leg.action == ("STO" if r.signed_qty > 0 else "BTO")
    assert lived
    for c in tables["position_continuation"]:
        r = wanted[(c.position_id - 1) % n]
        assert (c.continuation_exit_time, c.continuation_pnl) == (r.continuation_exit_time, r.continuation_pnl)
    assert results.run_tables(closed.limit(0).withColumn("backtest_id", F.lit(1)))["position_leg"].count() == 0

import pytest
from pyspark.sql import functions as F

from optlattice.plans import backtest, fixtures, strategy

SPREAD = """
strategy:
  name: spread
  universe: {start_date: "2024-01-01", end_date: "2024-02-01", session: {start: "09:30", end: "16:00"}, audit_filter: none}
  costs: {slippage_pct: 0.01, fee_per_contract: 1.3}
  trades:
    - name: put_spread
      instrument: {root_symbol: ES, tick_size: 0.05, roll_days_before_expiry: 3}
      legs:
        - {name: short, right: put, action: sell_to_open, delta: {target: -0.3, tolerance: 0.15}, dte: 10, dte_tolerance: 8}
        - {name: long, right: put, action: buy_to_open, strike_offset: -25, reference_leg: short}
      entry: {window: {start: "10:00", end: "14:00"}, min_credit: 0.5, max_entries_per_day: 1}
      exit: {stop_loss: 4.0, take_profit_pct: 0.4, dte_exit: 1}
"""


def test_definition_rules():
    data = strategy.load_strategy(SPREAD)
    s = strategy.parse_strategy(data)
    assert s.trades[0].legs[0].right == "P" and s.costs.per_contract() == (0.65, 0.65, 0.65)
    for path, value in [("trades.0.entry.window.start", "15:00"), ("trades.0.exit.take_profit", 1.0), ("trades.0.legs.1.reference_leg", "long"), ("trades.0.legs.0.stepped", {"steps": []}), ("trades.0.entry.conditions", ["max(a) > 1"]), ("trades.0.legs.1.name", "short"), ("trades.0.roll", {"window": None, "x": 1}), ("trades.0.exit.on_sl_long_continuation", True)]:
        broken = strategy.load_strategy(SPREAD)
        if path.endswith("continuation"):
            broken["trades"][0]["exit"]["leg_out"] = True
        strategy.override(broken, path, value)
        with pytest.raises(strategy.DefinitionError):
            strategy.parse_strategy(broken)
    with pytest.raises(strategy.DefinitionError):
        strategy.load_strategy("x: 1")


def test_sweeps():
    assert strategy.span(0.1, 0.3, 0.1) == [0.1, 0.2, 0.3] and strategy.span(3, 1, -1) == [3, 2, 1]
    data = strategy.load_strategy(SPREAD)
    data["trades"][0]["exit"]["stop_loss"] = [1.0, 2.0, None]
    data["trades"][0]["entry"]["min_credit"] = {"start": 0.5, "stop": 1.0, "step": 0.5}
    data["trades"][0]["legs"][0]["delta"]["target"] = [-0.2, -0.3]
    found = strategy.expand(data)
    assert [k for k, _, _ in found] == list(range(1, 13))
    assert found[0][1]["trades.0.entry.min_credit"] == 0.5 and found[1][1]["trades.0.legs.0.delta.target"] == -0.3
    with pytest.raises(strategy.DefinitionError):
        strategy.expand(data, max_combinations=5)
    assert [k for k, _, _ in strategy.expand_study([data, data])] == list(range(1, 25))
    explicit = strategy.load_strategy(SPREAD) | {"combinations": {"columns": ["trades.0.exit.stop_loss"], "rows": [[1.0], [9.0]]}}
    assert [c["trades"][0]["exit"]["stop_loss"] for _, _, c in strategy.expand(explicit)] == [1.0, 9.0]


@pytest.fixture(scope="module")
def market(spark, sf_dir, tmp_path_factory):
    """Stored market tables."""
    root = tmp_path_factory.mktemp("market")
    tables = {"underlying_bars": fixtures.underlying_bars(spark, sf_dir), "option_bars": fixtures.option_bars(spark, sf_dir), "option_greeks": fixtures.option_greeks(spark, sf_dir).where("T > 0")}
    for name, table in tables.items():
        table.coalesce(1).write.parquet(f"{root}/{name}")
    return {name: spark.read.parquet(f"{root}/{name}") for name in tables}


def test_a_whole_backtest(market):
    s = strategy.parse_strategy(strategy.load_strategy(SPREAD))
    rows = backtest.run(s, market).orderBy("entry_time").collect()
    assert rows
    end = None
    for r in rows:
        assert len(r.legs) == 2 and r.exit_time > r.entry_time
        assert end is None or r.entry_time >= end  # no two at a time
        end = r.exit_time
        assert r.net_pnl == pytest.approx((r.open_mark - r.exit_mark) * 50 - abs(r.exit_mark) * 0.5 - 2 * 1.3, abs=0.01)
    assert max(sum(1 for r in rows if r.entry_time.date() == d) for d in {r.entry_time.date() for r in rows}) == 1


def test_a_single_step_equals_a_flat_delta(market):
    flat, stepped = strategy.load_strategy(SPREAD), strategy.load_strategy(SPREAD)
    leg = stepped["trades"][0]["legs"][0]
    stepped["trades"][0]["legs"][0] = {k: v for k, v in leg.items() if k not in ("delta", "dte", "dte_tolerance")} | {"stepped": {"source": "close", "steps": [{"delta": -0.3, "delta_tolerance": 0.15, "dte": 10, "dte_tolerance": 8}]}}
    found = []
    for data in (flat, stepped):
        s = strategy.parse_strategy(data)
        e = backtest.find_entries(s, s.trades[0], market)
        found.append(sorted((str(r.entry_time), r.open_mark) for r in e.select("entry_time", F.round("open_mark", 6).alias("open_mark")).collect()))
    assert found[0] and found[0] == found[1]


def changed(path=None, value=None, *more):
    data = strategy.load_strategy(SPREAD)
    for p, v in zip((path, *more[::2]), (value, *more[1::2]), strict=True):
        if p:
            strategy.override(data, p, v)
    return strategy.parse_strategy(data)


def closed(market, *changes):
    return backtest.run(changed(*changes), market).orderBy("entry_time").collect()


@pytest.fixture(scope="module")
def plain_run(market):
    return closed(market)


TRADE = "trades.0."


def test_dates_bound_the_candidates(market, plain_run):
    rows = closed(market, "universe.start_date", "2024-01-10", "universe.end_date", "2024-01-12")
    days = {str(r.entry_time.date()) for r in rows}
    assert days and days <= {"2024-01-10", "2024-01-11", "2024-01-12"} and {str(r.entry_time.date()) for r in plain_run} - days


def test_take_profit_as_a_price_and_as_an_object(market, plain_run):
    s = changed(TRADE + "exit.take_profit_pct", None, TRADE + "exit.take_profit", 1.5)
    assert all(r.tp_price == pytest.approx(r.open_mark - 1.5, abs=0.026) for r in backtest.find_entries(s, s.trades[0], market).collect())
    for value, want in (({"price": 2.0}, lambda m: m - 2), ({"pct": 0.25}, lambda m: m * 0.75)):
        s = changed(TRADE + "exit.take_profit_pct", None, TRADE + "exit.take_profit", value)
        found = backtest.find_entries(s, s.trades[0], market).collect()
        assert found and all(r.tp_price == pytest.approx(want(r.open_mark), abs=0.026) for r in found)
    s = changed(TRADE + "exit.stop_loss", {"price": 3.0, "condition": "position_mark > 99"})
    assert all(r.sl_price == pytest.approx(r.open_mark + 3, abs=0.026) for r in backtest.find_entries(s, s.trades[0], market).collect())


def test_conditions_read_legs_and_indicators(market):
    trend = market["underlying_bars"].select("ts_event", F.col("instrument_id").alias("underlying_id"), (F.col("close") - 4000).alias("trend"))
    known = market | {"indicators": trend}
    s = changed()
    every = {r.entry_time: r for r in backtest.find_entries(s, s.trades[0], market).collect()}
    spot = {(r.underlying_id, r.ts_event): r.trend for r in trend.collect()}
    s = changed(TRADE + "entry.conditions", ["short.strike < 3970", "long.delta < -0.2", "trend < 6"])
    found = backtest.find_entries(s, s.trades[0], known).collect()
    leg = lambda r, name: next(x for x in r.legs if x.leg_name == name)
    want = sorted(t for t, r in every.items() if leg(r, "short").strike_price < 3970 and leg(r, "long").delta < -0.2)
    front = {t for t in want if any(v < 6 for (u, x), v in spot.items() if x == t)}
    assert 0 < len(found) < len(every) and {r.entry_time for r in found} <= front and [r.entry_id for r in sorted(found, key=lambda r: r.entry_time)] == list(range(len(found)))
    rows = backtest.run(changed(TRADE + "exit.conditions", ["trend > 8"]), known).collect()
    stopped = [r for r in rows if r.exit_reason == "condition"]
    assert stopped and all(spot[r.underlying_id, r.exit_time] > 8 for r in stopped)


def test_time_tolerance_reaches_options_at_other_times(market):
    late = market | {n: market[n].withColumn("ts_event", F.timestamp_add("SECOND", F.lit(40), "ts_event").cast("timestamp_ntz")) for n in ("option_bars", "option_greeks")}
    count = lambda s, m: backtest.find_entries(s, s.trades[0], m).count()
    exact, near, short = changed(), changed(TRADE + "entry.time_tolerance", 60), changed(TRADE + "entry.time_tolerance", 30)
    assert count(exact, late) == count(short, late) == 0 and count(near, late) == count(near, market) == count(exact, market) > 0


def test_continuations_gate_and_pay(market, plain_run):
    assert all(r.continuation_pnl is None for r in plain_run)
    stop = (TRADE + "exit.stop_loss", 0.5, TRADE + "entry.max_entries_per_day", 10)
    without = closed(market, *stop)
    rows = closed(market, *stop, TRADE + "exit.on_sl_long_continuation", True, TRADE + "exit.long_trailing_stop_pct", 0.4)
    lived = [r for r in rows if r.continuation_pnl is not None]
    assert lived and all(r.exit_reason == "stop_loss" and r.continuation_exit_time > r.exit_time for r in lived)
    assert all(r.continuation_pnl == pytest.approx((r.continuation_exit_price - r.continuation_entry_price) * 50) for r in lived)
    for r, after in zip(rows, rows[1:], strict=False):
        if r.continuation_exit_time:
            assert after.entry_time >= r.continuation_exit_time and after.entry_time.date() > r.exit_time.date()
    assert len(rows) < len(without) or [r.entry_time for r in rows] != [r.entry_time for r in without]


def test_the_multiplier_is_the_contract_s(market, plain_run):
    tenfold = market | {"option_bars": market["option_bars"].withColumn("multiplier", F.lit(500))}
    assert [r.gross_pnl for r in closed(tenfold)] == pytest.approx([10 * r.gross_pnl for r in plain_run])


def test_leg_out_and_liquidity_reach_the_exits(market, plain_run):
    assert [r.exit_mark for r in closed(market, TRADE + "exit.leg_out", True)] != [r.exit_mark for r in plain_run]
    assert not [r for r in closed(market, TRADE + "exit.liquidity", {"min_exit_volume": 10**6}) if r.exit_reason in ("stop_loss", "take_profit")]


def test_a_study_keeps_failures_apart(market, tmp_path):
    from optlattice.plans import study

    good = strategy.load_strategy(SPREAD)
    good["trades"][0]["exit"]["stop_loss"] = [2.0, 4.0]
    bad = strategy.load_strategy(SPREAD)
    bad["trades"][0]["exit"]["conditions"] = ["no_such_indicator > 1"]
    rows, failed = study.run_study([good, bad, good], market)
    assert [f["combination_id"] for f in failed] == [3] and "no_such_indicator" in failed[0]["error"]
    got = {}
    for r in rows.collect():
        got.setdefault(r.combination_id, []).append((r.entry_time, r.exit_time, r.net_pnl))
    assert sorted(got) == [1, 2, 4, 5] and sorted(got[1]) == sorted(got[4]) and sorted(got[2]) == sorted(got[5])
    alone = backtest.run(changed(TRADE + "exit.stop_loss", 2.0), market).collect()
    assert sorted((r.entry_time, r.exit_time, r.net_pnl) for r in alone) == sorted(got[1])
    legs = study.SharedLegs(market)
    for _, _, d in strategy.expand(good):
        legs.of(d, strategy.parse_strategy(d))
    assert len(legs.found) == 1
    (tmp_path / "s.yaml").write_text(SPREAD)
    (tmp_path / "study.yaml").write_text("study: {name: x, strategies: [s.yaml, {path: s.yaml}]}")
    assert study.read_strategies(tmp_path / "study.yaml") == [strategy.load_strategy(SPREAD)] * 2

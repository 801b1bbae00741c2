import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from optlattice.functions import clock, conditions, expr, pricing


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def cdf(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def test_normal_cdf_matches_erfc(spark):
    xs = [x / 10 for x in range(-80, 81, 3)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", pricing.normal_cdf(F.col("x")).alias("p")).collect()
    assert max(abs(r.p - cdf(r.x)) for r in rows) < 1e-14


@pytest.mark.parametrize("f,k,t,s", [(4000.0, 4000.0, 0.1, 0.2), (4000.0, 4200.0, 0.5, 0.35), (3900.0, 3500.0, 0.02, 0.15)])
def test_prices_and_greeks(spark, f, k, t, s):
    args = [F.lit(x) for x in (f, k, t, s)]
    row = one(spark, c=pricing.price(*args, F.lit("C")), p=pricing.price(*args, F.lit("P")), up=pricing.price(F.lit(f + 0.01), *args[1:], F.lit("C")), down=pricing.price(F.lit(f - 0.01), *args[1:], F.lit("C")), v=pricing.price(*args[:3], F.lit(s + 1e-4), F.lit("C")), g=pricing.greeks(*args, F.lit("C")))
    assert row.c - row.p == pytest.approx(math.exp(-0.01 * t) * (f - k), abs=1e-9)  # put-call parity
    assert row.g.delta == pytest.approx((row.up - row.down) / 0.02, abs=1e-5)
    assert row.g.gamma == pytest.approx((row.up - 2 * row.c + row.down) / 1e-4, abs=1e-4)
    assert row.g.vega == pytest.approx((row.v - row.c) / 1e-4, rel=1e-2)


def test_prices_without_time_are_zero_and_greeks_nan(spark):
    row = one(spark, p=pricing.price(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.2), F.lit("C")), g=pricing.greeks(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.2), F.lit("C")))
    assert row.p == 0 and math.isnan(row.g.delta) and math.isnan(row.g.vega)


def test_implied_volatility_round_trip():
    sigma = np.array([0.05, 0.2, 0.8, 2.0])
    f, k, t = np.full(4, 4000.0), np.array([3990.0, 4100, 3800, 4000]), np.full(4, 0.25)
    d1 = (np.log(f / k) + sigma**2 / 2 * t) / (sigma * np.sqrt(t))
    price = np.exp(-0.01 * t) * (f * pricing._cdf(d1) - k * pricing._cdf(d1 - sigma * np.sqrt(t)))
    assert pricing.bisect_iv(price, f, k, t, np.full(4, True)) == pytest.approx(sigma, abs=1e-5)
    assert np.isnan(pricing.bisect_iv(np.array([0.0]), f[:1], k[:1], t[:1], np.array([True]))).all()


def test_failed_volatility_is_nan_not_null(spark):
    row = one(spark, iv=pricing.implied_vol(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit("C")))
    assert math.isnan(row.iv)


def test_local_clock_knows_summer_time(spark):
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    row = one(spark, w=F.hour(clock.local(ts("2026-03-06 14:30:00"))), s=F.hour(clock.local(ts("2026-03-09 14:30:00"))), t=clock.years_to_expiry(ts("2024-01-01 20:00:00"), F.lit("2024-01-02").cast("date")), past=clock.years_to_expiry(ts("2024-01-03 20:00:00"), F.lit("2024-01-02").cast("date")), d=clock.from_epoch_nanos(F.lit(86_400_000_000_000 * 3 + 5)), none=clock.from_epoch_nanos(F.lit(0)))
    assert (row.w, row.s) == (9, 10)
    assert row.t == pytest.approx(1 / 365.25) and row.past == 0
    assert str(row.d) == "1970-01-04" and row.none is None


def test_rounding_bounds_and_division(spark):
    row = one(spark, a=expr.tick_round(F.lit(2.125), 0.25), b=expr.tick_round(F.lit(2.1), 0), c=expr.clip_to_bound(F.lit(5.0), F.lit(-1.0)), d=expr.clip_to_bound(F.lit(-5.0), F.lit(1.0)), e=expr.clip_to_bound(F.lit(5.0), F.lit(None).cast("double")), f=expr.divide(F.lit(1.0), F.lit(0.0)), g=expr.intrinsic(F.lit("P"), F.lit(90.0), F.lit(100.0)), h=expr.contract_root(F.lit("ESM6")))
    assert (row.a, row.b, row.c, row.d, row.e) == (2.25, 2.1, 0.0, 0.0, None)
    assert row.f == math.inf and row.g == 10 and row.h == "ES"


@pytest.mark.parametrize("text,want", [("a > 1", True), ("a > 1 and b > 1", None), ("a > 1 or b > 1", True), ("not a > 3", True), ("a + 2 * 3 - 1 == 7", True), ("abs(-3) == 3", True), ("if a > 1 then a > 5", False), ("put.delta < -0.2", True), ("put.strike >= 100", True), ("a / 0 > 5", True)])
def test_conditions(spark, text, want):
    df = spark.createDataFrame([(2.0, None, -0.3, 100.0)], "a double, b double, leg_put_delta double, leg_put_strike_price double")
    conditions.check_condition(text)
    assert df.select(conditions.compile_condition(text).alias("c")).first().c == want


@pytest.mark.parametrize("text", ["1 < a < 3", "max(a, 1) > 2", "-a > 1", "a if b else c", "a >", "__import__('os')", "a[0] > 1", "lambda: 1"])
def test_forbidden_conditions(spark, text):
    with pytest.raises(conditions.ConditionError):
        conditions.check_condition(text)
    with pytest.raises(conditions.ConditionError):
        conditions.compile_condition(text)


def test_steps_and_targets(spark):
    df = spark.createDataFrame([(5.0,), (15.0,), (99.0,), (None,)], "v double")
    ladder = [{"below": 10, "delta": 0.1}, {"below": 20, "delta": 0.2}, {"delta": 0.3}]
    got = [r.s and r.s.delta for r in df.select(conditions.steps(F.col("v"), ladder, ("delta",)).alias("s")).collect()]
    assert got == [0.1, 0.2, 0.3, None]
    named = {"b": {"priority": 2, "condition": "v > 3", "dte": 7}, "a": {"priority": 1, "condition": "v > 50", "dte": 45}, "default": {"dte": 1}}
    assert [r.t.name for r in df.select(conditions.targets(named, ("dte",)).alias("t")).collect()] == ["b", "b", "a", "default"]

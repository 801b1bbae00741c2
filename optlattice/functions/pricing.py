"""Black-76 prices, greeks and implied volatility."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The rate of the stored greeks.
RATE = 0.01
#: The fields of greeks().
GREEKS = ("delta", "gamma", "theta", "vega")
#: Bisection: bounds, accepted price error, steps at most.
IV_LOW, IV_HIGH, IV_ERROR, IV_STEPS = 1e-4, 10.0, 1e-6, 100
#: The coefficients of Hart's rational approximation of the normal distribution, highest power first.
_TOP = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_BOTTOM = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(x, coefficients):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row: the expressions would grow with every use."""
    return F.transform(F.array(value), use)[0]


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution, within 1e-15."""
    return _once(x, _normal_cdf)


def _normal_cdf(x: Column) -> Column:
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    near = e * _horner(a, [F.lit(c) for c in _TOP]) / _horner(a, [F.lit(c) for c in _BOTTOM])
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a > 37, 0.0).when(a < 7.07106781186547, near).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_pdf(x: Column) -> Column:
    return F.exp(-x * x / 2) / F.lit(np.sqrt(2 * np.pi))


def d1_d2(f: Column, k: Column, t: Column, sigma: Column) -> tuple[Column, Column]:
    spread = sigma * F.sqrt(t)
    d1 = (F.ln(f / k) + sigma * sigma / 2 * t) / spread
    return d1, d1 - spread


def usable(f: Column, k: Column, t: Column, sigma: Column) -> Column:
    return (f > 0) & (k > 0) & (t > 0) & (sigma > 0) & ~F.isnan(sigma)


def price(f: Column, k: Column, t: Column, sigma: Column, right: Column, r: float = RATE) -> Column:
    """Black-76 price of a call (C) or put; 0 where F, K, T or sigma isn't positive."""
    d1, d2 = d1_d2(f, k, t, sigma)

    def value(d: Column) -> Column:
        call = f * _once(d["d1"], _normal_cdf) - k * _once(d["d2"], _normal_cdf)
        return F.exp(-r * t) * F.when(right == "C", call).otherwise(call - f + k)

    return F.when(usable(f, k, t, sigma), _once(F.struct(d1.alias("d1"), d2.alias("d2")), value)).otherwise(0.0)


def greeks(f: Column, k: Column, t: Column, sigma: Column, right: Column, r: float = RATE) -> Column:
    """A struct of delta, gamma, theta (a day) and vega (a unit of volatility); NaN where they can't be computed."""
    d1, d2 = d1_d2(f, k, t, sigma)
    parts = F.struct(d1.alias("d1"), normal_cdf(d1).alias("n1"), normal_cdf(d2).alias("n2"), F.sqrt(t).alias("root"), F.exp(-r * t).alias("discount"))

    def value(p: Column) -> Column:
        density = normal_pdf(p["d1"])
        call = f * p["n1"] - k * p["n2"]
        worth = p["discount"] * F.when(right == "C", call).otherwise(call - f + k)
        return F.struct(
            (p["discount"] * F.when(right == "C", p["n1"]).otherwise(p["n1"] - 1)).alias("delta"),
            (p["discount"] * density / (f * sigma * p["root"])).alias("gamma"),
            ((-f * p["discount"] * density * sigma / (2 * p["root"]) + r * worth) / 365).alias("theta"),
            (f * p["discount"] * density * p["root"]).alias("vega"),
        )

    missing = F.struct(*(F.lit(float("nan")).alias(n) for n in GREEKS))
    return F.when(usable(f, k, t, sigma), _once(parts, value)).otherwise(missing)


def _cdf(x: np.ndarray) -> np.ndarray:
    a = np.minimum(np.abs(x), 38.0)
    e = np.exp(-a * a / 2)
    near = e * _horner(a, _TOP) / _horner(a, _BOTTOM)
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = np.where(a > 37, 0.0, np.where(a < 7.07106781186547, near, far))
    return np.where(x > 0, 1 - tail, tail)


def bisect_iv(p: np.ndarray, f: np.ndarray, k: np.ndarray, t: np.ndarray, call: np.ndarray, r: float = RATE) -> np.ndarray:
    """Implied volatility of many options at once; NaN where price, time or forward isn't positive.

    The middle of the last interval, when its price is within the error or the steps are used up.
    """
    p, f, k, t = (np.asarray(x, dtype=float) for x in (p, f, k, t))
    out = np.full(len(p), np.nan)
    open_ = np.flatnonzero((p > 0) & (t > 0) & (f > 0) & (k > 0))
    low, high = np.full(len(open_), IV_LOW), np.full(len(open_), IV_HIGH)
    for step in range(IV_STEPS):
        mid = (low + high) / 2
        ff, kk, tt = f[open_], k[open_], t[open_]
        spread = mid * np.sqrt(tt)
        d1 = (np.log(ff / kk) + mid * mid / 2 * tt) / spread
        value = ff * _cdf(d1) - kk * _cdf(d1 - spread)
        value = np.exp(-r * tt) * np.where(call[open_], value, value - ff + kk)
        done = np.abs(value - p[open_]) < IV_ERROR
        out[open_] = mid
        above = value > p[open_]
        high, low = np.where(above, mid, high)[~done], np.where(above, low, mid)[~done]
        open_ = open_[~done]
        if not len(open_):
            break
    return out


@F.pandas_udf(DoubleType())
def _implied_vol(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for p, f, k, t, right in parts:
        yield pd.Series(bisect_iv(p, f, k, t, (right == "C").to_numpy()))


def implied_vol(p: Column, f: Column, k: Column, t: Column, right: Column) -> Column:
    """Implied volatility by bisection, in Arrow batches; a failed one is NaN, not null."""
    return F.coalesce(_implied_vol(p.cast("double"), f.cast("double"), k.cast("double"), t.cast("double"), right), F.lit(float("nan")))

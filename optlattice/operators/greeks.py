"""Option greeks from bars and as-of spot prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clock, pricing
from .asof import backward_bounded


def compute(option_bars: DataFrame, underlying_bars: DataFrame, stored: DataFrame | None = None, max_lag_minutes: int = 5) -> DataFrame:
    """(ts_event, instrument_id, underlying_id, dte, T, iv, delta, gamma, theta, vega, underlying_lag_s) of bars with a close.

    The forward is the last underlying close within the lag. Bars that are stored already are left out. A failed
    volatility is NaN and so are its greeks.
    """
    bars = option_bars.where(F.col("close").isNotNull())
    if stored is not None:
        bars = bars.join(stored.select("instrument_id", "ts_event"), ["instrument_id", "ts_event"], "left_anti")
    spot = underlying_bars.select(F.col("instrument_id").alias("underlying_id"), "ts_event", F.col("close").alias("spot"))
    rows = backward_bounded(bars, spot, ["underlying_id"], ["spot"], max_lag_minutes * 60, lag="underlying_lag_s")
    ts, expiration = F.col("ts_event"), F.col("expiration")
    rows = rows.withColumns({"dte": clock.dte(ts, expiration), "T": clock.years_to_expiry(ts, expiration)})
    rows = rows.withColumn("iv", pricing.implied_vol(F.col("close"), F.col("spot"), F.col("strike_price"), F.col("T"), F.col("right")))
    found = pricing.greeks(F.col("spot"), F.col("strike_price"), F.col("T"), F.col("iv"), F.col("right"))
    return rows.withColumn("_g", found).select("ts_event", "instrument_id", "underlying_id", "dte", "T", "iv", *(f"_g.{n}" for n in pricing.GREEKS), "underlying_lag_s")

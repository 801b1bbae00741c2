"""Market views of the driver's tables, as DataFrames and as the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, pricing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


def text(c: Column | str) -> Column:
    """An instant as text, so that both engines show it alike."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


#: Minute bars of eight instruments out of `events`.
BARS = """bars AS (SELECT user_id % 8 AS instrument_id, date_trunc('minute', ts) AS ts_event, arg_min(value, ts) AS open,
 max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null").select("user_id", ntz("ts").alias("ts"), "value")
    minute = F.date_trunc("minute", "ts").cast("timestamp_ntz")
    return e.groupBy((F.col("user_id") % 8).alias("instrument_id"), minute.alias("ts_event")).agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.count("*").alias("volume"))


#: Closed trades out of orders and the last shipment of their lines; profits have four exact decimals.
TRADES = """trades AS (SELECT o_orderkey AS id, o_custkey % 8 AS backtest_id, any_value(o_orderdate) AS open_time, max(l_shipdate) AS exit_time,
 round(sum(l_extendedprice * (1 - l_discount)) - any_value(o_totalprice), 4) AS net_pnl, round(any_value(o_totalprice) / 1000, 5) AS open_mark,
 round(max(l_extendedprice) / 1000, 5) AS worst_mark, round(min(l_extendedprice) / 1000, 5) AS exit_mark
 FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey HAVING max(l_shipdate) > any_value(o_orderdate))"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    rows = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    out = rows.groupBy(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 8).alias("backtest_id")).agg(
        F.first("o_orderdate").cast("timestamp_ntz").alias("open_time"),
        F.max("l_shipdate").cast("timestamp_ntz").alias("exit_time"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))) - F.first("o_totalprice"), 4).alias("net_pnl"),
        F.round(F.first("o_totalprice") / 1000, 5).alias("open_mark"),
        F.round(F.max("l_extendedprice") / 1000, 5).alias("worst_mark"),
        F.round(F.min("l_extendedprice") / 1000, 5).alias("exit_mark"),
    )
    return out.where("exit_time > open_time")


def _cdf_sql(x: str) -> str:
    top, bottom = pricing._TOP, pricing._BOTTOM
    poly = lambda cs: "".join("(" for _ in cs[1:]) + repr(cs[0]) + "".join(f" * abs({x}) + {c!r})" for c in cs[1:])
    return f"(CASE WHEN {x} > 0 THEN 1 - exp(-{x} * {x} / 2) * {poly(top)} / {poly(bottom)} ELSE exp(-{x} * {x} / 2) * {poly(top)} / {poly(bottom)} END)"


#: Hourly closes of two futures, options on them around 4000 at 20 % volatility, and their forward prices.
CHAIN = f"""hours AS MATERIALIZED (SELECT user_id % 2 AS underlying_id, date_trunc('hour', ts) AS ts_event, round(4000 + (arg_max(value, ts) - 50) / 4, 2) AS spot
 FROM events WHERE value IS NOT NULL GROUP BY 1, 2),
grid AS MATERIALIZED (SELECT h.*, CAST(3925 + 25 * k.i AS DOUBLE) AS strike_price, r.r AS right_, CASE WHEN underlying_id = 0 THEN DATE '2024-01-19' ELSE DATE '2024-02-02' END AS expiration,
 1000 + 100 * underlying_id + 2 * k.i + CASE WHEN r.r = 'C' THEN 0 ELSE 1 END AS instrument_id
 FROM hours h CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS i) k CROSS JOIN (SELECT unnest(['C', 'P']) AS r) r),
timed AS MATERIALIZED (SELECT *, greatest(0.0, (date_diff('day', DATE '1970-01-01', expiration) * 86400.0 + 72000 - epoch(ts_event)) / 31557600.0) AS t FROM grid),
dd AS MATERIALIZED (SELECT *, CASE WHEN t > 0 THEN (ln(spot / strike_price) + 0.02 * t) / (0.2 * sqrt(t)) END AS d1,
 CASE WHEN t > 0 THEN (ln(spot / strike_price) + 0.02 * t) / (0.2 * sqrt(t)) - 0.2 * sqrt(t) END AS d2 FROM timed),
nn AS MATERIALIZED (SELECT *, {_cdf_sql("d1")} AS n1, {_cdf_sql("d2")} AS n2 FROM dd),
chain AS MATERIALIZED (SELECT instrument_id, underlying_id, ts_event, expiration, strike_price, right_, spot, t, d1,
 CASE WHEN t > 0 THEN exp(-0.01 * t) * CASE WHEN right_ = 'C' THEN spot * n1 - strike_price * n2 ELSE strike_price * (1 - n2) - spot * (1 - n1) END ELSE 0.0 END AS close,
 CASE WHEN t > 0 THEN exp(-0.01 * t) * CASE WHEN right_ = 'C' THEN n1 ELSE n1 - 1 END END AS delta,
 date_diff('day', CAST(ts_event AS DATE), expiration) AS dte FROM nn)"""


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null").select("user_id", ntz("ts").alias("ts"), "value")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    spot = F.round(4000 + (F.max_by("value", "ts") - 50) / 4, 2)
    return e.groupBy((F.col("user_id") % 2).alias("underlying_id"), hour.alias("ts_event")).agg(spot.alias("spot"))


def underlying_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hours(spark, sf_dir)
    expiration = F.when(F.col("underlying_id") == 0, F.lit("2024-01-19")).otherwise(F.lit("2024-02-02")).cast("date")
    symbol = F.when(F.col("underlying_id") == 0, "ESF4").otherwise("ESG4")
    return h.select("ts_event", F.col("underlying_id").alias("instrument_id"), symbol.alias("symbol"), expiration.alias("expiration"), *(F.col("spot").alias(c) for c in ("open", "high", "low", "close")), F.lit(1).alias("volume"))


def option_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hours(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("right", F.explode(F.array(F.lit("C"), F.lit("P"))))
    h = h.withColumn("strike_price", (F.col("k") * 25 + 3925).cast("double"))
    h = h.withColumn("expiration", F.when(F.col("underlying_id") == 0, F.lit("2024-01-19")).otherwise(F.lit("2024-02-02")).cast("date"))
    h = h.withColumn("instrument_id", F.lit(1000) + F.col("underlying_id") * 100 + F.col("k") * 2 + F.when(F.col("right") == "C", 0).otherwise(1))
    t = clock.years_to_expiry(F.col("ts_event"), F.col("expiration"))
    close = pricing.price(F.col("spot"), F.col("strike_price"), t, F.lit(0.2), F.col("right"))
    return h.withColumns({"t": t, "close": close}).select("ts_event", "instrument_id", "underlying_id", "expiration", "strike_price", "right", F.lit(50).alias("multiplier"), *(F.col("close").alias(c) for c in ("open", "high", "low", "close")), F.lit(1).alias("volume"), "spot", "t")


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars and greeks of live options in one table."""
    b = option_bars(spark, sf_dir).where("t > 0")
    found = pricing.greeks(F.col("spot"), F.col("strike_price"), F.col("t"), F.lit(0.2), F.col("right"))
    return b.withColumn("_g", found).select("ts_event", "instrument_id", "underlying_id", "expiration", "strike_price", "right", "multiplier", "close", clock.dte(F.col("ts_event"), F.col("expiration")).alias("dte"), *(f"_g.{n}" for n in pricing.GREEKS))


def option_greeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greeks at the known volatility."""
    b = option_bars(spark, sf_dir)
    found = pricing.greeks(F.col("spot"), F.col("strike_price"), F.col("t"), F.lit(0.2), F.col("right"))
    return b.withColumn("_g", found).select("ts_event", "instrument_id", "underlying_id", clock.dte(F.col("ts_event"), F.col("expiration")).alias("dte"), F.col("t").alias("T"), F.lit(0.2).alias("iv"), *(f"_g.{n}" for n in pricing.GREEKS))

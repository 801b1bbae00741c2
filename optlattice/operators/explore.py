"""Chart queries: resampling, overlays, listings, heatmaps, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.expr import contract_root
from .exit import held
from .ranks import kept


def bucket(ts: Column, size: str, zone: str = clock.NEW_YORK) -> Column:
    """The start, on the zone's clock, of the interval that holds an instant: Nm, Nh, 1d, 1w (Monday) or 1M."""
    local = clock.local(ts, zone)
    n, unit = int(size[:-1]), size[-1]
    if unit in "dwM":
        return F.date_trunc({"d": "day", "w": "week", "M": "month"}[unit], local).cast("timestamp_ntz")
    step = n * (60 if unit == "m" else 3600)
    second = clock.seconds_of_day(local)
    return F.timestamp_add("SECOND", (second - second % step).cast("int"), F.date_trunc("day", local)).cast("timestamp_ntz")


def resample(bars: DataFrame, size: str, zone: str = clock.NEW_YORK, keys: Sequence[str] = ("instrument_id",)) -> DataFrame:
    """Open, high, low, close and volume per bucket. Bars of one time: the order is that of the values."""
    first, last = F.struct("ts_event", "open"), F.struct("ts_event", "close")
    return bars.groupBy(*keys, bucket(F.col("ts_event"), size, zone).alias("bucket")).agg(F.min_by("open", first).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", last).alias("close"), F.sum("volume").alias("volume"))


def resample_indicator(values: DataFrame, size: str, zone: str = clock.NEW_YORK, keys: Sequence[str] = ("indicator_id",)) -> DataFrame:
    """The last value that isn't null per bucket."""
    rows = values.where(F.col("value").isNotNull())
    return rows.groupBy(*keys, bucket(F.col("ts_event"), size, zone).alias("bucket")).agg(F.max_by("value", F.struct("ts_event", "value")).alias("value"))


def contracts(bars: DataFrame) -> DataFrame:
    """Per instrument and per root: first and last bar and their number; level tells which."""
    one = bars.groupBy("instrument_id", "symbol").agg(F.min("ts_event").alias("first_ts"), F.max("ts_event").alias("last_ts"), F.count("*").alias("n_bars"))
    one = one.withColumns({"level": F.lit("contract"), "root": contract_root(F.col("symbol"))})
    roots = one.groupBy("root").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n_bars").alias("n_bars")).withColumn("level", F.lit("root"))
    return one.unionByName(roots, allowMissingColumns=True)


def stitch(values: DataFrame, schedule: DataFrame) -> DataFrame:
    """Values of the contract that the schedule names for their date."""
    on = (F.to_date(values["ts_event"]) == schedule["date"]) & (values["underlying_id"] == schedule["underlying_id"])
    return values.join(F.broadcast(schedule.select("date", "underlying_id")), on, "left_semi")


def overlay(positions: DataFrame, legs: DataFrame, instruments: DataFrame, root: str, start: str, end: str) -> DataFrame:
    """Positions with a leg on an instrument whose symbol begins with root, open at some time of [start, end)."""
    named = instruments.where(F.col("symbol").startswith(root)).select("instrument_id")
    hit = legs.join(named, "instrument_id", "left_semi").select("position_id")
    rows = positions.where((F.col("open_time") < F.lit(end).cast("timestamp_ntz")) & (F.col("exit_time") >= F.lit(start).cast("timestamp_ntz")))
    return rows.join(hit, rows["id"] == hit["position_id"], "left_semi")


def running_pnl(bars: DataFrame, legs: DataFrame, multiplier: float | Column) -> DataFrame:
    """(position_id, ts_event, pnl) once all legs of a position have a price; legs keep their last price between bars.

    The multiplier is a number or a column of the legs. bars are those of all options, or, with a position_id, each position's own.
    """
    multiplier = multiplier if isinstance(multiplier, Column) else F.lit(multiplier)
    every = legs.groupBy("position_id").agg(F.collect_list(F.struct("instrument_id", "signed_qty", "entry_price", multiplier.alias("_units"))).alias("legs"))
    named = ["position_id", "instrument_id"] if "position_id" in bars.columns else ["instrument_id"]
    rows = legs.select("position_id", "instrument_id").join(bars.select(*named, "ts_event", "close"), named).repartition("position_id")
    times = rows.groupBy("position_id", "ts_event").agg(F.collect_list(F.struct("instrument_id", "close")).alias("bars"))
    grid = times.join(every, "position_id").select("position_id", "ts_event", "bars", F.explode("legs").alias("l"))
    grid = grid.select("position_id", "ts_event", "l.*", F.get(F.filter("bars", lambda x: x["instrument_id"] == F.col("l.instrument_id")), 0)["close"].alias("close"))
    past = Window.partitionBy("position_id", "instrument_id").orderBy("ts_event").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.withColumn("_c", F.last("close", True).over(past))
    out = filled.groupBy("position_id", "ts_event").agg(F.sum(F.col("signed_qty") * (F.col("entry_price") - F.col("_c")) * F.col("_units")).alias("pnl"), F.count("_c").alias("_n"), F.count("*").alias("_m"))
    return out.where("_n = _m").select("position_id", "ts_event", "pnl")


def _price(c: Column) -> Column:
    """A strike without a needless fraction."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(F.format_string("%.1f", c))


def trade_chart(positions: DataFrame, legs: DataFrame, bars: DataFrame) -> DataFrame:
    """(position_id, series, at, value, label): what a chart shows of each position, as tall rows.

    positions has position_id, open_time, exit_time, exit_reason, open_mark, exit_mark, and take_profit_pct and stop_loss in points (null: none);
    legs has position_id, leg_index, instrument_id, signed_qty, strike_price, right, entry_price and multiplier; bars those of the options.
    Series: `pnl` in money from the opening (0) to the exit, once all legs have a price; `after_exit` from there to the end of the exit's
    day (UTC), where the legs keep their last prices; `strike`, `breakeven` (the lowest call strike plus, the highest put strike
    minus the credit), `take_profit` and `stop_loss` as levels without a time; `marker` at both ends. A position without prices
    of all legs has no pnl and after_exit, one without later prices no after_exit. Positions, legs and profits serve several
    series and are kept.
    """
    positions, legs = kept(positions), kept(legs)
    times = positions.select("position_id", "open_time", "exit_time", F.timestamp_add("MICROSECOND", F.lit(-1), F.timestamp_add("DAY", F.lit(1), F.date_trunc("day", "exit_time").cast("timestamp_ntz"))).alias("_end"))
    open_ = legs.join(times, "position_id").withColumns({"_from": F.timestamp_add("MICROSECOND", F.lit(-1), "open_time"), "_to": F.timestamp_add("MICROSECOND", F.lit(1), "_end")})
    priced = held(open_.select("position_id", "instrument_id", "_from", "_to").distinct(), bars.select("instrument_id", "ts_event", "close"))
    money = kept(running_pnl(priced, legs, F.col("multiplier")).join(times, "position_id"))
    inside = money.where((F.col("ts_event") > F.col("open_time")) & (F.col("ts_event") <= F.col("exit_time"))).select("position_id", "exit_time", "ts_event", F.round("pnl", 2).alias("pnl"))
    none = F.lit(None).cast("string")
    row = lambda df, series, at, value, label: df.select("position_id", F.lit(series).alias("series"), at.cast("timestamp_ntz").alias("at"), value.cast("double").alias("value"), label.alias("label"))
    last = inside.groupBy("position_id").agg(F.max_by("pnl", "ts_event").alias("pnl"), F.any_value("exit_time").alias("exit_time"))
    begun = last.join(times.select("position_id", "open_time"), "position_id")
    post = money.where(F.col("ts_event") > F.col("exit_time")).join(last.select("position_id"), "position_id", "left_semi")
    never = F.lit(None)
    sign = F.signum("signed_qty")
    spread = legs.groupBy("position_id").agg(
        F.sum(sign * F.col("entry_price")).alias("credit"),
        F.min(F.when(F.col("right") == "C", F.col("strike_price"))).alias("call"),
        F.max(F.when(F.col("right") == "P", F.col("strike_price"))).alias("put"),
        F.min_by(F.abs("signed_qty") * F.col("multiplier"), "leg_index").alias("notional"),
    ).join(positions.select("position_id", "take_profit_pct", "stop_loss"), "position_id")
    credit = F.abs("credit")
    ended = F.when(F.col("exit_reason") == "take_profit", "TP").when(F.col("exit_reason") == "stop_loss", "SL").otherwise(F.coalesce("exit_reason", F.lit("Exit")))
    closing = F.when(F.col("exit_reason") == "expiry", F.format_string("Exp %.2f", F.col("exit_mark").cast("double"))).otherwise(F.concat(F.format_string("Exit %.2f - ", F.col("exit_mark").cast("double")), ended))
    parts = [
        row(begun, "pnl", F.col("open_time"), F.lit(0.0), none),
        row(inside, "pnl", F.col("ts_event"), F.col("pnl"), none),
        row(last.join(post.select("position_id"), "position_id", "left_semi"), "after_exit", F.col("exit_time"), F.col("pnl"), none),
        row(post, "after_exit", F.col("ts_event"), F.round("pnl", 2), none),
        row(legs, "strike", never, F.col("strike_price"), F.concat(F.when(sign > 0, "S ").otherwise("L "), "right", _price(F.col("strike_price")))),
        row(spread.where("call is not null"), "breakeven", never, F.round(F.col("call") + credit, 2), F.lit("C-BE")),
        row(spread.where("put is not null"), "breakeven", never, F.round(F.col("put") - credit, 2), F.lit("P-BE")),
        row(spread.where("take_profit_pct is not null"), "take_profit", never, F.round(F.col("credit") * F.col("take_profit_pct") * F.col("notional"), 2), F.lit("TP")),
        row(spread.where("stop_loss is not null"), "stop_loss", never, F.round(-F.col("stop_loss") * F.col("notional"), 2), F.lit("SL")),
        row(positions, "marker", F.col("open_time"), F.col("open_mark"), F.format_string("Entry %.2f", F.col("open_mark").cast("double"))),
        row(positions, "marker", F.col("exit_time"), F.col("exit_mark"), closing),
    ]
    return reduce(DataFrame.unionByName, parts)


def padded_pnl(candles: DataFrame, pnl: DataFrame) -> DataFrame:
    """The last known profit at each candle; null before the first."""
    past = Window.partitionBy("position_id").orderBy("ts_event").rowsBetween(Window.unboundedPreceding, 0)
    return candles.join(pnl, ["position_id", "ts_event"], "left").withColumn("pnl", F.last("pnl", True).over(past))


def breakevens(entries: DataFrame) -> DataFrame:
    """(entry_id, breakeven): short strikes moved by the credit, up for calls and down for puts."""
    legs = entries.select("entry_id", "open_mark", F.explode("legs").alias("l")).where("l.signed_qty > 0")
    return legs.select("entry_id", F.when(F.col("l.right") == "C", F.col("l.strike_price") + F.col("open_mark")).otherwise(F.col("l.strike_price") - F.col("open_mark")).alias("breakeven"))


def heatmap(results: DataFrame, x: str, y: str, metric: str, values: Sequence, fixed: Mapping[str, object] | None = None) -> DataFrame:
    """metric over two sweep axes, the others fixed; x's values are stated, so no extra pass finds them."""
    for name, value in (fixed or {}).items():
        results = results.where(F.col(name) == value)
    return results.groupBy(y).pivot(x, list(values)).agg(F.min(metric))


def calendar(daily: DataFrame) -> DataFrame:
    """Adds week (number since the first day's Monday) and weekday (Monday is 0)."""
    first = daily.agg(F.date_trunc("week", F.min("day")).cast("date").alias("_first"))
    rows = daily.join(F.broadcast(first))
    return rows.withColumns({"week": F.floor(F.datediff("day", "_first") / 7).cast("int"), "weekday": F.weekday("day")}).drop("_first")


def swept(params: DataFrame, names: Sequence[str]) -> DataFrame:
    """(name, n_values) of parameters with more than one value, compared as text."""
    tall = params.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names))).alias("p")).select("p.*")
    return tall.groupBy("name").agg(F.countDistinct("value").alias("n_values")).where("n_values > 1")


def search(rows: DataFrame, text: str = "", tags: Sequence[str] = ()) -> DataFrame:
    """Rows whose name holds the text, whatever its case, and that carry all tags."""
    rows = rows.where(F.lower("name").contains(text.lower())) if text else rows
    return reduce(lambda r, t: r.where(F.array_contains("tags", t)), tags, rows)


def composite(weights: Mapping[str, float]) -> Column:
    """The weighted sum of metrics as they are."""
    return reduce(lambda a, b: a + b, (F.col(n) * w for n, w in weights.items()))


def worst_days(daily: DataFrame, n: int = 20) -> DataFrame:
    return daily.orderBy("pnl", "day").limit(n)


def best_backtest(results: DataFrame, metric: str = "sharpe") -> DataFrame:
    """The row with the largest metric; null counts as minus infinity, ties go to the smaller id."""
    key = F.struct(F.coalesce(F.col(metric), F.lit(float("-inf"))), -F.col("backtest_id"))
    return results.agg(F.max_by(F.struct(*results.columns), key).alias("b")).select("b.*")


def page(rows: DataFrame, order: Sequence[str], offset: int, n: int, filters: Mapping[str, str | tuple] | None = None) -> DataFrame:
    """Rows offset + 1 to offset + n of those that pass the filters: a text is part of the column's text, whatever its case, a pair is a range (None: open)."""
    for column, value in (filters or {}).items():
        if isinstance(value, str):
            rows = rows.where(F.lower(F.col(column).cast("string")).contains(value.lower()))
        else:
            low, high = value
            rows = rows.where(F.col(column) >= low) if low is not None else rows
            rows = rows.where(F.col(column) <= high) if high is not None else rows
    return rows.orderBy(*order).offset(offset).limit(n)


def buy_and_hold(prices: DataFrame, quantity: float = 1.0) -> DataFrame:
    """(date, pnl) of (date, close) prices against the first one."""
    first = prices.agg(F.min_by("close", "date").alias("p0"))
    return prices.join(F.broadcast(first)).select("date", F.round((F.col("close") - F.col("p0")) * quantity, 2).alias("pnl"))


def fingerprint(rows: DataFrame, id_col: str = "id", value_col: str = "net_pnl") -> DataFrame:
    """One text that changes when rows are added, removed or changed: the key of a result cache."""
    return rows.agg(F.concat_ws(":", F.count("*").cast("string"), F.max(id_col).cast("string"), F.round(F.sum(value_col), 2).cast("decimal(38,2)").cast("string")).alias("fingerprint"))


def strategy_summary(strategies: DataFrame) -> DataFrame:
    """The first trade's short leg (delta, dte) and exits out of a strategy's JSON."""
    leg = "struct<name:string,action:string,delta:struct<target:double>,dte:struct<target:int>>"
    trade = f"struct<legs:array<{leg}>,entry:struct<min_credit:double>,exit:struct<stop_loss:double,take_profit_pct:double>>"
    first = F.from_json("strategy_params", f"struct<trades:array<{trade}>>")["trades"]
    first = F.get(first, 0)
    short = F.get(F.filter(first["legs"], lambda x: x["action"] == "sell_to_open"), 0)
    return strategies.select("backtest_id", short["delta"]["target"].alias("delta"), short["dte"]["target"].alias("dte"), first["exit"]["take_profit_pct"].alias("take_profit_pct"), first["exit"]["stop_loss"].alias("stop_loss"), first["entry"]["min_credit"].alias("min_credit"))

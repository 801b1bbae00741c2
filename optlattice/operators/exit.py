"""Pass 2: marks of open positions and the first bar that closes each."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.conditions import column_name, compile_condition
from ..functions.expr import any_of, clip_to_bound, intrinsic, no_arbitrage, tick_round, truthy

#: Exit reasons by priority; 1 and 2 are gaps, filled at the bar's open.
REASONS = {1: "stop_loss", 2: "take_profit", 3: "stop_loss", 4: "take_profit", 5: "condition", 6: "roll", 7: "vega_exit", 8: "dte_exit", 9: "expiry"}


@dataclass(frozen=True)
class ExitRules:
    """What closes a position. Unset thresholds never do; conditions are texts."""

    zone: str = clock.NEW_YORK
    session: tuple[str, str] = ("09:30", "16:00")
    weekdays_only: bool = True
    after_hours: bool = False
    dte_exit: int | None = None
    vega_exit: float | None = None
    expiry_exit: bool = True
    expiry_close: str | None = None
    conditions: tuple[str, ...] = ()
    stop_loss_condition: str | None = None
    take_profit_condition: str | None = None
    confirmation_bars: int = 1
    min_exit_volume: int | None = None
    lookback_minutes: int = 3
    pre_expiry_lock_minutes: int | None = None
    max_leg_stale_minutes: int | None = None
    spread_slippage: bool = False
    roll_window: tuple[str, str] | None = None
    roll_dte: int | None = None
    roll_vega: float | None = None
    roll_conditions: tuple[str, ...] = field(default=())
    tick: float = 0.0

    def texts(self) -> tuple[str, ...]:
        return (*self.conditions, *self.roll_conditions, *(c for c in (self.stop_loss_condition, self.take_profit_condition) if c))

    def needs_vega(self) -> bool:
        """Whether a trigger or a condition reads the position's vega."""
        return self.vega_exit is not None or self.roll_vega is not None or any(n in c for c in self.texts() for n in ("spread_vega", "open_vega"))


def end_of(expiration: str, zone: str) -> Column:
    """The instant at which the expiration day is over on the zone's clock."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), F.date_add(expiration, 1).cast("timestamp_ntz"))


def met(legs: DataFrame, bars: DataFrame) -> DataFrame:
    """Rows of legs, one for each day they are open, with the bars of their instrument on that day."""
    last = F.to_date(F.timestamp_add("MICROSECOND", F.lit(-1), "_to"))
    days = legs.where(F.col("_from") < F.col("_to")).withColumn("_day", F.explode(F.sequence(F.to_date("_from"), last)))
    return days.join(bars.withColumn("_day", F.to_date("ts_event")), ["instrument_id", "_day"])


def held(legs: DataFrame, bars: DataFrame) -> DataFrame:
    """Rows of legs with each bar of their instrument after _from and before _to. What the join makes beyond these is at most what a leg's first and last day hold."""
    return met(legs, bars).where((F.col("ts_event") > F.col("_from")) & (F.col("ts_event") < F.col("_to"))).drop("_day", "_from", "_to")


def leg_bars(entries: DataFrame, bars: DataFrame, zone: str = clock.NEW_YORK) -> DataFrame:
    """Every bar of every leg after its entry and up to the position's expiration on the zone's clock, with all legs of the position.

    Both ends are instants of each entry, so bars of another contract with the same id at other times don't count.
    """
    legs = entries.select("entry_id", "entry_time", F.col("entry_time").alias("_from"), end_of("trade_expiration", zone).alias("_to"), "legs", F.explode("legs").alias("l")).select("entry_id", "entry_time", "_from", "_to", "legs", "l.leg_name", "l.instrument_id")
    return held(legs, bars.select("instrument_id", "ts_event", "open", "high", "low", "close", "volume"))


def marks(entries: DataFrame, bars: DataFrame, zone: str = clock.NEW_YORK) -> DataFrame:
    """(entry_id, ts_event, position_mark, spread_open_mark, min_leg_volume, total_slippage, max_leg_stale_minutes).

    Legs that have no bar at a time keep their last price; a position is marked once each of its legs has traded
    since the entry. Bars after the expiration don't count. Bars are shuffled once, by position: grouping by time, the fill per leg and the sum over
    legs all keep that partitioning, whatever the number of legs.
    """
    rows = leg_bars(entries, bars, zone).repartition("entry_id")
    bar = F.struct("leg_name", "open", "high", "low", "close", "volume")
    times = rows.groupBy("entry_id", "ts_event").agg(F.collect_list(bar).alias("bars"), F.first("legs").alias("legs"))
    grid = times.select("entry_id", "ts_event", "bars", F.size("legs").alias("n_legs"), F.explode("legs").alias("l"))
    grid = grid.select("entry_id", "ts_event", "n_legs", "l.leg_name", "l.signed_qty", F.get(F.filter("bars", lambda x: x["leg_name"] == F.col("l.leg_name")), 0).alias("b"))
    grid = grid.select("entry_id", "ts_event", "n_legs", "leg_name", "signed_qty", "b.open", "b.high", "b.low", "b.close", "b.volume")
    past = Window.partitionBy("entry_id", "leg_name").orderBy("ts_event").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.withColumns({"_c": F.last("close", True).over(past), "_o": F.last("open", True).over(past), "_seen": F.last(F.when(F.col("close").isNotNull(), F.col("ts_event")), True).over(past)})
    stale = clock.minute_number(F.col("ts_event")) - clock.minute_number(F.col("_seen"))
    half = F.abs("signed_qty") * F.coalesce((F.col("high") - F.col("low")) / 2, F.lit(0.0))
    out = filled.groupBy("entry_id", "ts_event").agg(
        F.sum(F.col("signed_qty") * F.col("_c")).alias("position_mark"),
        F.sum(F.col("signed_qty") * F.col("_o")).alias("spread_open_mark"),
        F.min(F.coalesce("volume", F.lit(0))).alias("min_leg_volume"),
        F.sum(half).alias("total_slippage"),
        F.max(stale).alias("max_leg_stale_minutes"),
        F.count("_c").alias("_priced"),
        F.max("n_legs").alias("_n"),
    )
    return out.where("_priced = _n").drop("_priced", "_n")


def spread_vega(entries: DataFrame, greeks: DataFrame, zone: str = clock.NEW_YORK) -> DataFrame:
    """(entry_id, ts_event, spread_vega): the signed sum of the legs' vegas, after the entry and up to the expiration on the zone's clock."""
    legs = entries.select("entry_id", F.col("entry_time").alias("_from"), end_of("trade_expiration", zone).alias("_to"), F.explode("legs").alias("l")).select("entry_id", "_from", "_to", "l.instrument_id", "l.signed_qty")
    return held(legs, greeks.select("instrument_id", "ts_event", "vega")).groupBy("entry_id", "ts_event").agg(F.sum(F.col("signed_qty") * F.col("vega")).alias("spread_vega"))


def settlement_closes(underlying_bars: DataFrame, close_time: str = "16:00", zone: str = clock.NEW_YORK) -> DataFrame:
    """(underlying_id, date, settlement): the last close at or before the closing time of each local day."""
    local = clock.local(F.col("ts_event"), zone)
    rows = underlying_bars.where(clock.seconds_of_day(local) <= clock.at(close_time))
    return rows.groupBy(F.col("instrument_id").alias("underlying_id"), F.to_date(local).alias("date")).agg(F.max_by("close", "ts_event").alias("settlement"))


def settlement_marks(entries: DataFrame, closes: DataFrame) -> DataFrame:
    """(entry_id, settlement_mark): the signed intrinsic value of the legs at the settlement of the position's expiration."""
    legs = entries.select("entry_id", "underlying_id", "trade_expiration", F.explode("legs").alias("l"))
    on = (legs["underlying_id"] == closes["underlying_id"]) & (legs["trade_expiration"] == closes["date"])
    value = F.col("l.signed_qty") * intrinsic(F.col("l.right"), F.col("settlement"), F.col("l.strike_price"))
    return legs.join(closes, on).groupBy("entry_id").agg(F.sum(value).alias("settlement_mark"))


def condition(text: str) -> Column:
    """A condition on a marked bar; _spread_vega is the position's vega at the bar, open_vega that of its first bar with one."""
    return compile_condition(text, lambda name: F.col(column_name(name.removeprefix("_") if name == "_spread_vega" else name)))


def watched(position_marks: DataFrame, entries: DataFrame, rules: ExitRules, indicators: DataFrame | None = None, vega: DataFrame | None = None, settlement: DataFrame | None = None) -> DataFrame:
    """Marks up to the expiration with what triggers read: running_worst, vegas, dte_now, and _ok, whether the gates let a price-triggered exit pass.

    Indicators have one row per ts_event, or per ts_event and underlying_id: a position reads those of its own underlying.
    vega is that of spread_vega(), for rules that need it.
    """
    known = [c for c in ("underlying_id",) if indicators is not None and c in indicators.columns]
    levels = [c for c in ("tp_price", "sl_price") if c in entries.columns]
    meta = entries.select("entry_id", "entry_time", "open_mark", *levels, "trade_expiration", *known)
    meta = meta.join(settlement, "entry_id", "left") if settlement is not None else meta.withColumn("settlement_mark", F.lit(None).cast("double"))
    local = clock.local(F.col("ts_event"), rules.zone)
    m = position_marks.join(meta, "entry_id").withColumn("local_ts", local).where(F.to_date("local_ts") <= F.col("trade_expiration"))
    past = Window.partitionBy("entry_id").orderBy("ts_event")
    m = m.withColumn("running_worst", F.max("position_mark").over(past.rowsBetween(Window.unboundedPreceding, 0)))
    m = m.join(indicators, ["ts_event", *known], "left") if indicators is not None else m
    if vega is None:
        m = m.withColumns({c: F.lit(None).cast("double") for c in ("spread_vega", "open_vega")})
    else:
        m = m.join(vega, ["entry_id", "ts_event"], "left")
        m = m.withColumn("open_vega", F.min_by("spread_vega", F.when(F.col("spread_vega").isNotNull(), F.col("ts_event"))).over(Window.partitionBy("entry_id")))
    m = m.withColumns({"dte_now": F.datediff("trade_expiration", F.to_date("local_ts")), "local_sec": clock.seconds_of_day(F.col("local_ts"))})
    return m.withColumn("_ok", _gates(rules, past))


def _slip(rules: ExitRules) -> Column:
    return F.col("total_slippage") if rules.spread_slippage else F.lit(0.0)


def _extra(text: str | None) -> Column:
    return truthy(condition(text)) if text else F.lit(True)


def flagged(position_marks: DataFrame, entries: DataFrame, rules: ExitRules, indicators: DataFrame | None = None, vega: DataFrame | None = None, settlement: DataFrame | None = None) -> DataFrame:
    """Marks with running_worst, every trigger, and the priority (1 to 9, null if nothing fires) of each bar; see watched()."""
    m = watched(position_marks, entries, rules, indicators, vega, settlement)
    past, slip = Window.partitionBy("entry_id").orderBy("ts_event"), _slip(rules)
    sl, tp = _extra(rules.stop_loss_condition), _extra(rules.take_profit_condition)
    hit = lambda mark, sign, level, extra: truthy((F.col(mark) + slip >= F.col(level)) if sign > 0 else (F.col(mark) + slip <= F.col(level))) & F.col("_ok") & extra
    m = m.withColumns({"gap_sl": hit("spread_open_mark", 1, "sl_price", sl), "gap_tp": hit("spread_open_mark", -1, "tp_price", tp), "sl": hit("position_mark", 1, "sl_price", sl), "tp": hit("position_mark", -1, "tp_price", tp)})
    if rules.confirmation_bars > 1:
        n = rules.confirmation_bars
        m = m.withColumn("tp", F.sum(F.col("tp").cast("int")).over(past.rowsBetween(-(n - 1), 0)) >= n)
    m = m.withColumns(_triggers(rules))
    calm = ~F.col("gap_sl") & ~F.col("gap_tp")
    order = [(1, F.col("gap_sl")), (2, F.col("gap_tp")), (3, F.col("sl") & calm), (4, F.col("tp") & calm), (5, F.col("condition")), (6, F.col("roll")), (7, F.col("vega_hit")), (8, F.col("dte_hit")), (9, F.col("expiry"))]
    return m.withColumn("priority", F.coalesce(*(F.when(c, n) for n, c in order)))


#: Thresholds that differ between combinations of a study that share everything else.
LEVELS = ("tp_price", "sl_price", "dte_exit", "vega_exit", "roll_dte", "roll_vega")


def records(m: DataFrame, rules: ExitRules) -> DataFrame:
    """The bars of watched() that can be the first to reach some threshold, whatever its value, and each position's last one.

    A threshold is first reached at a bar that goes beyond all bars before it. So of each value that is compared with one only the
    records are kept, and of what doesn't depend on thresholds the first: a few dozen bars instead of a position's whole
    life. One pass over windows by position; what it returns is enough for any number of combinations.
    """
    order, slip = Window.partitionBy("entry_id").orderBy("ts_event"), _slip(rules)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sl, tp = F.col("_ok") & _extra(rules.stop_loss_condition), F.col("_ok") & _extra(rules.take_profit_condition)
    rolls, fixed = _roll(rules)
    low = F.when(tp, F.col("position_mark") + slip)
    if (n := rules.confirmation_bars) > 1:
        last = order.rowsBetween(-(n - 1), 0)
        low = F.when(F.count(low).over(last) >= n, F.max(low).over(last))
    m = m.withColumns({"_gap_sl": F.when(sl, F.col("spread_open_mark") + slip), "_gap_tp": F.when(tp, F.col("spread_open_mark") + slip), "_sl": F.when(sl, F.col("position_mark") + slip), "_tp": low, "_condition": any_of([condition(c) for c in rules.conditions]), "_rolls": rolls, "_fixed": fixed & rolls, "_expiry": _expiry(rules)})
    m = m.withColumns({"_roll_dte": F.when(F.col("_rolls"), F.col("dte_now")), "_roll_vega": F.when(F.col("_rolls"), F.col("spread_vega"))})
    up = lambda c: truthy(F.col(c) > F.max(c).over(before)) | (F.col(c).isNotNull() & F.max(c).over(before).isNull())
    down = lambda c: truthy(F.col(c) < F.min(c).over(before)) | (F.col(c).isNotNull() & F.min(c).over(before).isNull())
    first = lambda c: F.col(c) & ~truthy(F.max(c).over(before))
    rank = F.struct(_fresh(rules), F.col("ts_event"))
    keep = [up("_gap_sl"), up("_sl"), *map(down, ("_gap_tp", "_tp", "dte_now", "spread_vega", "_roll_dte", "_roll_vega")), *map(first, ("_condition", "_fixed", "_expiry"))]
    m = m.withColumns({"_keep": any_of(keep), "_last": rank == F.max(rank).over(Window.partitionBy("entry_id"))})
    return m.where(F.col("_keep") | F.col("_last")).drop("_keep", "_last")


def judged(bars: DataFrame, levels: DataFrame) -> DataFrame:
    """The bars of records() once for each row of levels of their position (entry_id, LEVELS), with the priority of each."""
    rows = bars.join(levels, "entry_id")
    c = F.col
    order = [(1, c("_gap_sl") >= c("sl_price")), (2, c("_gap_tp") <= c("tp_price")), (3, c("_sl") >= c("sl_price")), (4, c("_tp") <= c("tp_price")), (5, c("_condition")), (6, c("_fixed") | (c("_roll_dte") <= c("roll_dte")) | (c("_roll_vega") < c("roll_vega"))), (7, c("spread_vega") < c("vega_exit")), (8, c("dte_now") <= c("dte_exit")), (9, c("_expiry"))]
    return rows.withColumn("priority", F.coalesce(*(F.when(hit, n) for n, hit in order)))


def rolling_volume(minutes: int) -> Column:
    """The volume of a position's bars in the minutes up to and with each."""
    recent = Window.partitionBy("entry_id").orderBy(clock.epoch_micros(F.col("ts_event"))).rangeBetween(-minutes * 60_000_000 + 1, 0)
    return F.sum("min_leg_volume").over(recent)


def _gates(rules: ExitRules, past: Window) -> Column:
    """Session, liquidity, lock before expiry, staleness and no-arbitrage: all must let a price-triggered exit pass."""
    ok = truthy(no_arbitrage(F.col("open_mark"), F.col("position_mark")))
    if not rules.after_hours:
        ok = ok & clock.in_window(F.col("local_ts"), *rules.session)
    if rules.weekdays_only:
        ok = ok & clock.is_weekday(F.col("local_ts"))
    if rules.min_exit_volume is not None:
        ok = ok & (rolling_volume(rules.lookback_minutes) >= rules.min_exit_volume)
    if rules.pre_expiry_lock_minutes is not None:
        close = clock.at(rules.expiry_close or rules.session[1])
        ok = ok & ~((F.col("dte_now") == 0) & F.col("local_sec").between(close - 60 * rules.pre_expiry_lock_minutes, close))
    if rules.max_leg_stale_minutes is not None:
        ok = ok & (F.col("max_leg_stale_minutes") <= rules.max_leg_stale_minutes)
    return ok


def _expiry(rules: ExitRules) -> Column:
    expiry = F.to_date("local_ts") >= F.col("trade_expiration")
    if rules.expiry_close:
        expiry = expiry & (F.col("local_sec") >= clock.at(rules.expiry_close))
    return truthy(expiry) if rules.expiry_exit else F.lit(False)


def _roll(rules: ExitRules) -> tuple[Column, Column]:
    """Whether a bar lies where rolls may happen, and whether a roll condition holds."""
    where = clock.in_window(F.col("local_ts"), *rules.roll_window) if rules.roll_window else F.lit(False)
    return where, any_of([condition(c) for c in rules.roll_conditions])


def _triggers(rules: ExitRules) -> dict[str, Column]:
    never = F.lit(False)
    where, roll = _roll(rules)
    roll = roll | truthy(F.col("dte_now") <= rules.roll_dte) if rules.roll_dte is not None else roll
    roll = roll | truthy(F.col("spread_vega") < rules.roll_vega) if rules.roll_vega is not None else roll
    return {
        "condition": any_of([condition(c) for c in rules.conditions]),
        "roll": roll & where,
        "vega_hit": truthy(F.col("spread_vega") < rules.vega_exit) if rules.vega_exit is not None else never,
        "dte_hit": truthy(F.col("dte_now") <= rules.dte_exit) if rules.dte_exit is not None else never,
        "expiry": _expiry(rules),
    }


def _fresh(rules: ExitRules) -> Column:
    return truthy(F.col("max_leg_stale_minutes") <= (rules.max_leg_stale_minutes if rules.max_leg_stale_minutes is not None else 1 << 30))


def first_exits(m: DataFrame, rules: ExitRules, by: tuple[str, ...] = ("entry_id",)) -> DataFrame:
    """(by, exit_time, exit_mark, worst_mark, exit_reason, priority) of every position that was ever marked.

    The first bar with a trigger closes a position. One that never triggers closes at its last bar, a fresh one
    if there is any, as expiry. Gaps fill at the open, expiries at the settlement if known, all else at the close
    within the no-arbitrage bound.
    """
    slip = _slip(rules)
    bar = clip_to_bound(F.col("open_mark"), F.col("position_mark") + slip)
    row = F.struct("ts_event", "priority", "position_mark", "spread_open_mark", "total_slippage", "running_worst", "open_mark", "settlement_mark")
    first = m.groupBy(*by).agg(F.min_by(row, F.when(F.col("priority").isNotNull(), F.struct("ts_event", "priority"))).alias("hit"), F.max_by(row, F.struct(_fresh(rules), F.col("ts_event"))).alias("last"))
    chosen = first.select(*by, F.coalesce("hit", "last").alias("c")).select(*by, "c.*")
    number = F.coalesce("priority", F.lit(9))
    fill = F.when(number <= 2, F.col("spread_open_mark") + slip).when((number == 9) & F.col("settlement_mark").isNotNull(), F.col("settlement_mark")).otherwise(bar)
    reason = F.element_at(F.create_map(*(F.lit(x) for kv in REASONS.items() for x in kv)), number)
    return chosen.select(*by, F.col("ts_event").alias("exit_time"), tick_round(fill, rules.tick).alias("exit_mark"), tick_round(F.col("running_worst"), rules.tick).alias("worst_mark"), reason.alias("exit_reason"), "priority")


def leg_out_fills(exits: DataFrame, legs: DataFrame, bars: DataFrame) -> DataFrame:
    """(entry_id, exit_mark): short legs close at their last bar up to the exit, long legs at their first bar after it (else the last before).

    legs has (entry_id, instrument_id, signed_qty). With _from and _to as well, as held() takes them, bars count in between only:
    a marked position has bars of all its legs there.
    """
    named = exits.select("entry_id", "exit_time").join(legs, "entry_id")
    priced = bars.select("instrument_id", "ts_event", "close")
    joined = held(named, priced) if "_from" in legs.columns else named.join(priced, "instrument_id")
    per_leg = joined.groupBy("entry_id", "instrument_id", "signed_qty").agg(F.max_by("close", F.when(F.col("ts_event") <= F.col("exit_time"), F.col("ts_event"))).alias("before"), F.min_by("close", F.when(F.col("ts_event") > F.col("exit_time"), F.col("ts_event"))).alias("after"))
    fill = F.when(F.col("signed_qty") > 0, F.col("before")).otherwise(F.coalesce("after", "before"))
    return per_leg.groupBy("entry_id").agg(F.sum(F.col("signed_qty") * fill).alias("exit_mark"))


def continuations(stopped: DataFrame, bars: DataFrame, trailing_pct: float = 0.5, settlement: DataFrame | None = None, zone: str = clock.NEW_YORK) -> DataFrame:
    """Long legs that live on after a stop loss: (entry_id, instrument_id, entry_price, exit_time, exit_price, exit_reason).

    stopped has (entry_id, instrument_id, exit_time, expiration). From the first bar after the exit a leg runs until its close falls to
    (1 - trailing_pct) of its running peak, or to its last bar up to the expiration on the zone's clock; then it is worth its
    intrinsic value at the settlement, if settlement (underlying_id, date, settlement) has one for the underlying_id,
    right and strike_price of stopped, else its last close.
    """
    open_ = stopped.select("entry_id", "instrument_id", F.col("exit_time").alias("_from"), end_of("expiration", zone).alias("_to"))
    rows = held(open_, bars.select("instrument_id", "ts_event", "close"))
    peak = F.max("close").over(Window.partitionBy("entry_id", "instrument_id").orderBy("ts_event").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("peak", peak)
    hit = (F.col("peak") > 0) & (F.col("close") <= F.col("peak") * (1 - trailing_pct))
    row = F.struct("ts_event", "close")
    found = rows.groupBy("entry_id", "instrument_id").agg(F.min_by("close", "ts_event").alias("entry_price"), F.min_by(row, F.when(hit, F.col("ts_event"))).alias("h"), F.max_by(row, "ts_event").alias("l"))
    last = F.col("l.close")
    if settlement is not None:
        value = stopped.select("entry_id", "instrument_id", "underlying_id", "right", "strike_price", F.col("expiration").alias("date")).join(settlement, ["underlying_id", "date"])
        found = found.join(value.select("entry_id", "instrument_id", intrinsic(F.col("right"), F.col("settlement"), F.col("strike_price")).alias("_worth")), ["entry_id", "instrument_id"], "left")
        last = F.coalesce("_worth", last)
    stop = F.col("h").isNotNull()
    return found.select("entry_id", "instrument_id", "entry_price", F.coalesce("h", "l")["ts_event"].alias("exit_time"), F.when(stop, F.col("h.close")).otherwise(last).alias("exit_price"), F.when(stop, "trailing_stop").otherwise("expiry").alias("exit_reason"))

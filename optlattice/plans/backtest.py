"""A whole backtest: entries, exits, enforcement, profit. One plan per trade."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.conditions import steps, targets
from ..functions.expr import contract_root, stop_loss_price, take_profit_price, tick_round
from ..operators import asof, audit, enforce, entry, exit, pnl
from ..operators.ranks import kept
from .strategy import Roll, Strategy, Trade


def wanted_legs(trade: Trade) -> list[entry.Wanted]:
    """How each leg of a trade is chosen."""
    found = []
    for leg in trade.legs:
        if leg.strike_offset is not None:
            found.append(entry.Wanted(leg.name, leg.right, offset=leg.strike_offset, reference=leg.reference_leg))
            continue
        fields = ("delta", "dte", "delta_tolerance", "dte_tolerance")
        if leg.targets is not None:
            t = targets(leg.targets, fields)
        elif leg.stepped is not None:
            t = steps(F.col(leg.stepped["source"]), leg.stepped["steps"], fields)
        else:
            d, n = leg.delta, leg.dte
            t = {"dte": F.lit(float(n["target"])), "dte_tolerance": F.lit(float(n["tolerance"]))}
            if "steps" in d:
                s = steps(F.col(d["step_source"]), d["steps"], ("target", "tolerance"))
                t |= {"delta": s["target"], "delta_tolerance": F.coalesce(s["tolerance"], F.lit(float(d["tolerance"])))}
            else:
                t |= {"delta": F.lit(float(d["target"])), "delta_tolerance": F.lit(float(d["tolerance"]))}
        found.append(entry.Wanted(leg.name, leg.right, t["delta"], F.coalesce(t["delta_tolerance"], F.lit(0.10)), t["dte"], F.coalesce(t["dte_tolerance"], F.lit(5.0))))
    return found


def _level(value, *names: str):
    """A number, or the first of these fields that a mapping sets."""
    return next((value[n] for n in names if value.get(n) is not None), None) if isinstance(value, dict) else value


def _indicators(market: dict[str, DataFrame]) -> DataFrame | None:
    return market.get("indicators")


def find_candidates(strategy: Strategy, trade: Trade, market: dict[str, DataFrame]) -> DataFrame:
    """Bars of the scheduled contract within the strategy's dates and the trade's entry window, with indicators as of each of them."""
    universe, session, spec = strategy.universe, strategy.universe.session, trade.instrument
    bars = market["underlying_bars"].where((F.col("symbol") == spec.root_symbol) | (contract_root(F.col("symbol")) == spec.root_symbol))
    listed = bars.where("expiration is not null").groupBy(F.col("instrument_id").alias("underlying_id")).agg(F.max("expiration").alias("expiry"))
    day = F.to_date(clock.local(F.col("ts_event"), session.timezone))
    if universe.start_date:
        bars = bars.where(day >= F.lit(str(universe.start_date)).cast("date"))
    if universe.end_date:
        bars = bars.where(day <= F.lit(str(universe.end_date)).cast("date"))
    schedule = entry.roll_schedule(bars.select(F.to_date("ts_event").alias("date")), listed, spec.roll_days_before_expiry)
    rows = entry.candidates(bars, schedule, (trade.entry.window["start"], trade.entry.window["end"]), session.timezone, session.weekdays_only, [str(d) for d in session.skip_dates])
    known = _indicators(market)
    if known is not None:
        by = [c for c in ("underlying_id",) if c in known.columns]
        names = [c for c in known.columns if c not in ("ts_event", "underlying_id")]
        rows = asof.session_fill(rows, known.select("ts_event", *by, *names), day, names, by)
    return rows


def find_legs(strategy: Strategy, trade: Trade, market: dict[str, DataFrame], rows: DataFrame) -> DataFrame:
    """The legs of all candidates."""
    searched = entry.contracts_to_search(rows, int(max([_largest(x) for x in trade.legs] or [0])))
    offered = market["option_greeks"].drop("underlying_id").join(market["option_bars"].select("instrument_id", "ts_event", "underlying_id", "expiration", "strike_price", "right", "multiplier", "close"), ["instrument_id", "ts_event"])
    offered = audit.drop_flagged(offered, market.get("flags"), strategy.universe.audit_filter)
    return entry.choose_legs(searched, offered, wanted_legs(trade), int(trade.entry.time_tolerance))


def find_entries(strategy: Strategy, trade: Trade, market: dict[str, DataFrame], first_id: int = 0, legs: DataFrame | None = None) -> DataFrame:
    """Entries of a trade from market tables underlying_bars, option_bars, option_greeks, and optional indicators and flags.

    Indicators are one row per ts_event and underlying_id. legs: those of find_legs(), if they are known already. Conditions
    read the candidate's bar, its indicators, the marks and, as leg.field, what is known of a leg.
    """
    rows = find_candidates(strategy, trade, market)
    legs = find_legs(strategy, trade, market, rows) if legs is None else legs
    actions = {leg.name: (leg.action, leg.quantity) for leg in trade.legs}
    n = thresholds(trade)
    found = entry.entries(legs, actions, trade.instrument.tick_size, n["tp_pct"], n["stop"], n["min_credit"], n["max_debit"], first_id, n["tp_price"])
    if not trade.entry.conditions:
        return found
    here = [c for c in rows.columns if c not in (*found.columns, "ts_event")]
    known = rows.groupBy(F.col("ts_event").alias("entry_time")).agg(F.max(F.struct(*here)).alias("_r")).select("entry_time", "_r.*")
    told = entry.with_leg_columns(found.join(known, "entry_time"), list(actions))
    return entry.numbered(entry.where_all(told, trade.entry.conditions).select(*(c for c in found.columns if c != "entry_id")), first_id)


def thresholds(trade: Trade) -> dict[str, float | None]:
    """The numbers of a trade that only decide which entries count and when they close."""
    x, names = trade.exit, ("price", "value", "target")
    pct = x.take_profit_pct if x.take_profit_pct is not None else _level(x.take_profit, "pct") if isinstance(x.take_profit, dict) else None
    rolls = trade.roll or Roll(dte=0)
    return {"min_credit": trade.entry.min_credit, "max_debit": trade.entry.max_debit, "tp_pct": pct, "tp_price": _level(x.take_profit, *names), "stop": _level(x.stop_loss, *names), "dte_exit": x.dte_exit, "vega_exit": x.vega_exit, "roll_dte": rolls.dte if trade.roll else None, "roll_vega": rolls.vega if trade.roll else None}


def _largest(leg) -> float:
    ladders = [leg.dte] if isinstance(leg.dte, dict) else []
    ladders += list((leg.targets or {}).values()) + list((leg.stepped or {}).get("steps", []))
    return max([x.get("target", x.get("dte", 0)) + x.get("tolerance", x.get("dte_tolerance", 5)) for x in ladders] or [0])


def exit_rules(strategy: Strategy, trade: Trade) -> exit.ExitRules:
    x, session, liquid = trade.exit, strategy.universe.session, trade.exit.liquidity
    window = (trade.roll.window or trade.entry.window) if trade.roll else None
    return exit.ExitRules(
        zone=session.timezone,
        session=(session.start, session.end),
        weekdays_only=session.weekdays_only,
        after_hours=x.allow_after_hours_exits,
        dte_exit=x.dte_exit,
        vega_exit=x.vega_exit,
        expiry_exit=x.expiry_exit,
        expiry_close=trade.instrument.expiry_close_time,
        conditions=tuple(x.conditions),
        stop_loss_condition=x.stop_loss.get("condition") if isinstance(x.stop_loss, dict) else None,
        take_profit_condition=x.take_profit.get("condition") if isinstance(x.take_profit, dict) else None,
        confirmation_bars=x.take_profit.get("confirmation_bars", 1) if isinstance(x.take_profit, dict) else 1,
        min_exit_volume=liquid.get("min_exit_volume"),
        lookback_minutes=liquid.get("lookback_minutes", 3),
        pre_expiry_lock_minutes=liquid.get("pre_expiry_lock_minutes"),
        max_leg_stale_minutes=liquid.get("max_leg_stale_minutes"),
        spread_slippage=liquid.get("slippage_model", "flat") == "spread",
        roll_window=(window["start"], window["end"]) if window else None,
        roll_dte=trade.roll.dte if trade.roll else None,
        roll_vega=trade.roll.vega if trade.roll else None,
        roll_conditions=tuple(trade.roll.conditions) if trade.roll else (),
        tick=trade.instrument.tick_size,
    )


def _long_leg(trade: Trade):
    """The long leg that lives on after a stop loss; None where the trade has no such rule or not one long leg."""
    long = [leg for leg in trade.legs if leg.action == "buy_to_open"]
    return long[0] if trade.exit.on_sl_long_continuation and len(long) == 1 else None


def continued(trade: Trade, entries: DataFrame, exits: DataFrame, bars: DataFrame, settlement: DataFrame, zone: str) -> DataFrame | None:
    """(entry_id, continuation_...) of the long leg that lives on after a stop loss; None without one."""
    long = _long_leg(trade)
    if long is None:
        return None
    leg = F.get(F.filter("legs", lambda x: x["leg_name"] == long.name), 0)
    legs = entries.select("entry_id", "underlying_id", *(leg[c].alias(c) for c in ("instrument_id", "expiration", "strike_price", "right", "multiplier")))
    stopped = exits.where("exit_reason = 'stop_loss'").select("entry_id", "exit_time").join(legs, "entry_id")
    found = exit.continuations(stopped, bars, trade.exit.long_trailing_stop_pct, settlement, zone).join(stopped.select("entry_id", "multiplier"), "entry_id")
    found = pnl.continuation_pnl(found, F.col("multiplier") * long.quantity)
    return found.select("entry_id", *(F.col(c).alias(f"continuation_{c}") for c in ("entry_price", "exit_time", "exit_price", "exit_reason", "pnl")))


def _open_legs(entries: DataFrame, zone: str) -> DataFrame:
    return entries.select("entry_id", F.col("entry_time").alias("_from"), exit.end_of("trade_expiration", zone).alias("_to"), F.explode("legs").alias("l")).select("entry_id", "_from", "_to", "l.instrument_id", "l.signed_qty")


def _watched(strategy: Strategy, trade: Trade, entries: DataFrame, market: dict[str, DataFrame], rules: exit.ExitRules) -> tuple[tuple, DataFrame, DataFrame]:
    """The arguments of exit.watched() and flagged() for kept entries, the bars of the options held, and the settlement closes."""
    bars = market["option_bars"].join(entries.select(F.explode("legs.instrument_id").alias("instrument_id")).distinct(), "instrument_id", "left_semi")
    vega = exit.spread_vega(entries, market["option_greeks"], rules.zone) if rules.needs_vega() else None
    closes = exit.settlement_closes(market["underlying_bars"], rules.expiry_close or strategy.universe.session.end, rules.zone)
    settle = exit.settlement_marks(entries, closes) if rules.expiry_close else None
    return (exit.marks(entries, bars, rules.zone), entries, rules, _indicators(market), vega, settle), bars, closes


_CONTINUATION = {f"continuation_{c}": k for c, k in (("entry_price", "double"), ("exit_time", "timestamp_ntz"), ("exit_price", "double"), ("exit_reason", "string"), ("pnl", "double"))}


def _after_exit(trade: Trade, entries: DataFrame, exits: DataFrame, bars: DataFrame, closes: DataFrame, zone: str) -> DataFrame:
    """Exits with the fills of a leg-out and the columns continuation_*."""
    if trade.exit.leg_out:
        fills = exit.leg_out_fills(exits.where(F.col("exit_reason") != "expiry"), _open_legs(entries, zone), bars).withColumnRenamed("exit_mark", "_fill")
        exits = exits.join(fills, "entry_id", "left").withColumn("exit_mark", F.coalesce("_fill", "exit_mark")).drop("_fill")
    more = continued(trade, entries, exits, bars, closes, zone)
    return exits.join(more, "entry_id", "left") if more is not None else exits.withColumns({c: F.lit(None).cast(k) for c, k in _CONTINUATION.items()})


def _closed(strategy: Strategy, trade: Trade, entries: DataFrame, exits: DataFrame, multiplier: float | None, keys: Sequence[str] = ()) -> DataFrame:
    """The positions that a trade could hold, with costs and profit. Each key is walked by itself; entry_id tells all positions of all keys apart."""
    session, zone = strategy.universe.session, strategy.universe.session.timezone
    both = entries.select("entry_id", "entry_time", *keys).join(exits.select("entry_id", "exit_time", "exit_reason"), "entry_id", "left")
    ends = exits.where("continuation_exit_time is not null").select("entry_id", F.col("continuation_exit_time").alias("exit_time"))
    both = enforce.gate_times(both, ends, session.start, zone, session.weekdays_only, session.skip_dates)
    both = both.withColumns({"day": F.to_date(clock.local(F.col("entry_time"), zone)), "trade_name": F.lit(trade.name)})
    walk = [*keys, "trade_name"]
    stay = enforce.greedy_walk(both, walk, trade.entry.max_entries_per_day)
    if trade.entry.no_reentry_after_loss:
        stay = enforce.no_reentry_after_loss(stay, walk)
    fee_in, fee_out, fee_end = strategy.costs.per_contract()
    units: float | Column = F.get(F.filter("legs", lambda x: x["leg_name"] == trade.legs[0].name), 0)["multiplier"] if multiplier is None else multiplier
    closed = pnl.profit(entries.join(stay.select("entry_id"), "entry_id", "left_semi"), exits, units, strategy.costs.slippage_pct, fee_in, fee_out, fee_end)
    return closed.withColumn("trade_name", F.lit(trade.name))


def run_trade(strategy: Strategy, trade: Trade, market: dict[str, DataFrame], multiplier: float | None = None, first_id: int = 0, legs: DataFrame | None = None) -> DataFrame:
    """Closed positions of one trade with costs and profit, after enforcement, and the columns continuation_*.

    The multiplier is that of the first leg's contract unless one is given. Entries and exits are used several times
    and are kept.
    """
    entries = kept(find_entries(strategy, trade, market, first_id, legs))
    rules = exit_rules(strategy, trade)
    seen, bars, closes = _watched(strategy, trade, entries, market, rules)
    exits = _after_exit(trade, entries, exit.first_exits(exit.flagged(*seen), rules), bars, closes, rules.zone)
    return _closed(strategy, trade, entries, kept(exits), multiplier)


#: Position ids of a study hold the combination above these bits, and the entry's number below them.
ENTRY_BITS = 40
_THRESHOLD_TYPES = "combination_id long, min_credit double, max_debit double, tp_pct double, tp_price double, stop double, dte_exit double, vega_exit double, roll_dte double, roll_vega double"


def reads_levels(trade: Trade) -> bool:
    """Whether a condition names a price level, which combinations can't share."""
    rolls = list(trade.roll.conditions) if trade.roll else []
    gates = [x["condition"] for x in (trade.exit.stop_loss, trade.exit.take_profit) if isinstance(x, dict) and x.get("condition")]
    return any(n in c for c in [*trade.entry.conditions, *trade.exit.conditions, *rolls, *gates] for n in ("tp_price", "sl_price"))


def run_shared(strategy: Strategy, trade: Trade, market: dict[str, DataFrame], numbers: dict[int, dict[str, float | None]], multiplier: float | None = None, legs: DataFrame | None = None) -> DataFrame:
    """The closed positions of run_trade() for many combinations at once, with combination_id; they differ in thresholds() alone.

    numbers: thresholds by combination. They are rows of a small table, as many as there are combinations. Entries are found, marked and watched once;
    bars that can be the first beyond some threshold (exit.records) meet the thresholds, and what follows has one row per
    combination and entry. Fills and continuations after an exit are found once for each entry and exit time. Entry ids are those of
    each combination by itself.
    """
    spark = market["option_bars"].sparkSession
    spec, rules = trade.instrument, exit_rules(strategy, trade)
    if any(n["vega_exit"] is not None or n["roll_vega"] is not None for n in numbers.values()):
        rules = replace(rules, vega_exit=0.0)  # only tells that vega is needed
    names = [x.split()[0] for x in _THRESHOLD_TYPES.split(", ")[1:]]
    table = F.broadcast(spark.createDataFrame([(k, *(None if n[c] is None else float(n[c]) for c in names)) for k, n in sorted(numbers.items())], _THRESHOLD_TYPES))
    plain = replace(trade, entry=replace(trade.entry, min_credit=None, max_debit=None), exit=replace(trade.exit, take_profit=None, take_profit_pct=None, stop_loss=None, on_sl_long_continuation=False))
    every = kept(find_entries(strategy, plain, market, 0, legs).drop("tp_price", "sl_price"))
    mark = F.col("open_mark")
    wanted = (F.col("min_credit").isNull() | (mark >= F.col("min_credit"))) & (F.col("max_debit").isNull() | (mark >= -F.abs("max_debit")))
    chosen = every.join(table, wanted)
    tp = F.coalesce(take_profit_price(mark, F.col("tp_pct")), take_profit_price(mark, None, F.col("tp_price")))
    chosen = chosen.withColumns({"_tp": tick_round(tp, spec.tick_size), "sl_price": tick_round(stop_loss_price(mark, F.col("stop")), spec.tick_size)}).withColumn("tp_price", F.col("_tp")).drop("_tp")
    seen, bars, closes = _watched(strategy, trade, every, market, rules)
    judged = exit.judged(exit.records(exit.watched(*seen), rules), chosen.select("combination_id", "entry_id", *exit.LEVELS))
    exits = exit.first_exits(judged, rules, ("entry_id", "combination_id"))
    if trade.exit.leg_out or _long_leg(trade) is not None:
        exits = _shared_after_exit(trade, every, kept(exits), bars, closes, rules.zone)
    else:
        exits = _after_exit(trade, every, exits, bars, closes, rules.zone)
    place = (F.shiftleft("combination_id", ENTRY_BITS) + F.col("entry_id")).alias("entry_id")
    entries = chosen.select("combination_id", place, *(c for c in every.columns if c != "entry_id"), "tp_price", "sl_price")
    exits = kept(exits.select(place, *(c for c in exits.columns if c not in ("entry_id", "combination_id"))))
    closed = _closed(strategy, trade, entries, exits, multiplier, ["combination_id"])
    return _renumbered(closed, chosen.select("combination_id", place, F.to_date("entry_time").alias("_day"), "entry_time"))


def _shared_after_exit(trade: Trade, entries: DataFrame, exits: DataFrame, bars: DataFrame, closes: DataFrame, zone: str) -> DataFrame:
    """_after_exit() once for each entry, exit time and reason, whatever the number of combinations that leave it so."""
    at = F.struct("entry_id", "exit_time", "exit_reason")
    cases = exits.groupBy(at.alias("entry_id")).agg(F.any_value("exit_time").alias("exit_time"), F.any_value("exit_reason").alias("exit_reason"), F.any_value("exit_mark").alias("exit_mark"))
    ids = cases.select(F.col("entry_id").alias("_case"), F.col("entry_id.entry_id").alias("entry_id"))
    cased = ids.join(entries, "entry_id").drop("entry_id").withColumnRenamed("_case", "entry_id")
    found = _after_exit(trade, cased, cases, bars, closes, zone)
    found = found.select(F.col("entry_id").alias("_case"), F.col("exit_mark").alias("_fill"), *_CONTINUATION)
    rows = exits.withColumn("_case", at).join(found, "_case").drop("_case")
    return (rows.withColumn("exit_mark", F.col("_fill")) if trade.exit.leg_out else rows).drop("_fill")


def _renumbered(closed: DataFrame, chosen: DataFrame) -> DataFrame:
    """Positions with the entry ids that each combination would give by itself: the number of its entries before, counted per day first."""
    per_day = chosen.groupBy("combination_id", "_day").count()
    before = Window.partitionBy("combination_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    per_day = per_day.select("combination_id", "_day", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = chosen.withColumn("_n", F.row_number().over(Window.partitionBy("combination_id", "_day").orderBy("entry_time")))
    ids = ranked.join(per_day, ["combination_id", "_day"]).select("combination_id", "entry_id", (F.col("_before") + F.col("_n") - 1).cast("long").alias("_id"))
    return closed.join(ids, ["combination_id", "entry_id"]).withColumn("entry_id", F.col("_id")).drop("_id")


def run(strategy: Strategy, market: dict[str, DataFrame], multiplier: float | None = None, legs: dict[str, DataFrame] | None = None) -> DataFrame:
    """All trades of a strategy. Entry ids are per trade; legs: those of find_legs() by trade, if they are known already."""
    out = None
    for trade in strategy.trades:
        rows = run_trade(strategy, trade, market, multiplier, legs=(legs or {}).get(trade.name))
        out = rows if out is None else out.unionByName(rows)
    return out

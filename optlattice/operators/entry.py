"""Pass 1: where and with which legs positions are opened. Legs are rows, not columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import clock
from ..functions.conditions import compile_condition
from ..functions.expr import stop_loss_price, take_profit_price, tick_round
from . import pnl

#: What is known of a chosen option.
LEG_FIELDS = ("search_id", "instrument_id", "expiration", "strike_price", "right", "multiplier", "close", "delta", "iv", "gamma", "theta", "vega", "dte")


def roll_schedule(days: DataFrame, contracts: DataFrame, roll_days: int = 7) -> DataFrame:
    """(date, underlying_id, expiry, next_underlying_id) for every date: the first contract that expires at least roll_days later, else the last.

    contracts has (underlying_id, expiry), a few per year. The next contract is the one that follows by expiry.
    """
    order = Window.orderBy("expiry", "underlying_id")
    listed = contracts.withColumn("next_underlying_id", F.lead("underlying_id").over(order))
    fits = F.col("expiry") >= F.date_add("date", roll_days)
    row = F.struct("underlying_id", "expiry", "next_underlying_id")
    choice = days.select("date").distinct().join(F.broadcast(listed)).groupBy("date").agg(F.min_by(row, F.when(fits, F.struct("expiry", "underlying_id"))).alias("first"), F.max_by(row, F.struct("expiry", "underlying_id")).alias("last"))
    return choice.select("date", F.coalesce("first", "last").alias("c")).select("date", "c.*")


def candidates(underlying_bars: DataFrame, schedule: DataFrame, window: tuple[str, str], zone: str = clock.NEW_YORK, weekdays_only: bool = True, skip_dates: Sequence[str] = ()) -> DataFrame:
    """Bars of the scheduled contract inside the entry window, with the contract's expiry and the next contract."""
    local = clock.local(F.col("ts_event"), zone)
    keep = clock.in_window(local, *window)
    if weekdays_only:
        keep = keep & clock.is_weekday(local)
    if skip_dates:
        keep = keep & ~F.to_date(local).cast("string").isin(*skip_dates)
    bars = underlying_bars.where(keep).withColumn("date", F.to_date("ts_event"))
    on = (bars["date"] == schedule["date"]) & (bars["instrument_id"] == schedule["underlying_id"])
    return bars.join(F.broadcast(schedule), on).select(*(bars[c] for c in bars.columns), schedule["underlying_id"], schedule["expiry"], schedule["next_underlying_id"])


def contracts_to_search(rows: DataFrame, largest_dte: int) -> DataFrame:
    """One row per candidate and contract: the next contract, too, where the front one expires too soon for the target."""
    soon = F.datediff("expiry", "date") <= largest_dte
    both = F.array(F.col("underlying_id"), F.when(soon, F.col("next_underlying_id")))
    return rows.withColumn("search_id", F.explode(F.filter(both, lambda x: x.isNotNull())))


@dataclass(frozen=True)
class Wanted:
    """How one leg is chosen: the option nearest to a delta within tolerances of delta and dte, or nearest to another leg's strike plus an offset.

    Targets are columns of the candidates; a candidate whose target is null has no such leg.
    """

    name: str
    right: str
    delta: Column | None = None
    delta_tolerance: Column | None = None
    dte: Column | None = None
    dte_tolerance: Column | None = None
    offset: float | None = None
    reference: str | None = None
    reach: float = 1.0


def choose_legs(rows: DataFrame, options: DataFrame, wanted: Sequence[Wanted], time_tolerance: int = 0) -> DataFrame:
    """The legs of each candidate (search_id, ts_event), one row each: ts_event, leg_name and the option's fields.

    options are greeks joined with bars; candidates meet them once, and one aggregation per time chooses all legs. An option
    counts at the candidate's own time, or at its date's nearest time within the tolerance (seconds) at which the leg is
    found, the earlier of two. A leg with an offset comes from the time, underlying and expiration of its reference.
    Ties: the smaller strike, then the smaller id. NaN deltas match nothing.
    """
    by_delta, by_offset = [w for w in wanted if w.offset is None], [w for w in wanted if w.offset is not None]
    targets = [F.struct(w.delta.cast("double").alias("d"), w.delta_tolerance.cast("double").alias("dt"), w.dte.cast("double").alias("n"), w.dte_tolerance.cast("double").alias("nt")).alias(f"_w{i}") for i, w in enumerate(by_delta)]
    asked = rows.select("ts_event", "search_id", *targets)
    offered = options.where(F.col("right").isin(*{w.right for w in wanted}) & F.col("close").isNotNull()).withColumnRenamed("underlying_id", "search_id")
    fields = [c for c in LEG_FIELDS if c in offered.columns]
    offered = offered.select(F.col("ts_event").alias("_t"), *fields)
    joined, gap = _meet(asked, offered, time_tolerance)
    option = F.struct(*fields, "_t")
    found = []
    for i, w in enumerate(by_delta):
        t = F.col(f"_w{i}")
        fits = (F.col("right") == w.right) & F.col("delta").between(t["d"] - t["dt"], t["d"] + t["dt"]) & F.col("dte").between(t["n"] - t["nt"], t["n"] + t["nt"])
        found.append(F.min_by(option, F.when(fits, F.struct(gap, "_t", F.abs(F.col("delta") - t["d"]), "strike_price", "instrument_id"))).alias(w.name))
    chains = [F.collect_list(F.when(F.col("right") == r, option)).alias(f"_chain{r}") for r in sorted({w.right for w in by_offset})]
    best = joined.groupBy("ts_event").agg(*found, *chains)
    for w in by_offset:
        ref, goal = F.col(w.reference), F.col(f"{w.reference}.strike_price") + w.offset
        near = F.filter(f"_chain{w.right}", lambda o: (o["search_id"] == ref["search_id"]) & (o["expiration"] == ref["expiration"]) & (o["_t"] == ref["_t"]) & (F.abs(o["strike_price"] - goal) <= w.reach))  # noqa: B023
        ranked = F.transform(near, lambda o: F.struct(F.abs(o["strike_price"] - goal).alias("a"), o["strike_price"].alias("k"), o["instrument_id"].alias("i"), o.alias("o")))  # noqa: B023
        best = best.withColumn(w.name, F.array_min(ranked)["o"])
    legs = F.array_compact(F.array(*(F.when(F.col(w.name).isNotNull(), F.struct(F.lit(w.name).alias("leg_name"), F.col(w.name).alias("b"))) for w in wanted)))
    return best.select("ts_event", F.explode(legs).alias("l")).select("ts_event", "l.leg_name", *(F.col(f"l.b.{c}").alias("underlying_id" if c == "search_id" else c) for c in fields))


def _meet(asked: DataFrame, offered: DataFrame, tolerance: int) -> tuple[DataFrame, Column]:
    """Candidates with the options of their contract that are near enough in time, and how near."""
    if not tolerance:
        return asked.join(offered, (asked["ts_event"] == offered["_t"]) & (asked["search_id"] == offered["search_id"])).drop(asked["search_id"]), F.lit(0)
    cell = lambda c: F.floor(clock.epoch_seconds(F.col(c)) / tolerance).cast("long")
    left = asked.withColumn("_c", F.explode(F.array(*(cell("ts_event") + d for d in (-1, 0, 1))))).withColumnRenamed("search_id", "_s")
    gap = F.abs(clock.epoch_micros(F.col("ts_event")) - clock.epoch_micros(F.col("_t")))
    right = offered.withColumn("_cell", cell("_t"))
    joined = left.join(right, (left["_c"] == right["_cell"]) & (left["_s"] == right["search_id"]))
    return joined.where((gap <= tolerance * 1_000_000) & (F.to_date("ts_event") == F.to_date("_t"))), gap


def with_leg_columns(entries: DataFrame, names: Sequence[str]) -> DataFrame:
    """Adds the fields of each named leg as columns leg_<name>_<field>, as conditions name them."""
    fields = entries.schema["legs"].dataType.elementType.names
    one = lambda n: F.get(F.filter("legs", lambda x: x["leg_name"] == n), 0)
    return entries.withColumns({f"leg_{n}_{f}": one(n)[f] for n in names for f in fields if f != "leg_name"})


def entries(legs: DataFrame, actions: Mapping[str, tuple[str, int]], tick: float = 0.0, take_profit_pct: float | None = None, stop_loss: float | None = None, min_credit: float | None = None, max_debit: float | None = None, first_id: int = 0, take_profit: float | None = None) -> DataFrame:
    """One row per time at which every leg of `actions` was found: entry_id by time, open_mark, tp_price, sl_price, and the legs as an array.

    open_mark is the signed sum of the closes, credits positive, rounded to the tick. Ids are counted per day, so no task
    ranks all entries.
    """
    table = F.create_map(*(F.lit(x) for n, (a, q) in actions.items() for x in (n, q if a in ("sell_to_open", "STO") else -q)))
    rows = legs.withColumn("signed_qty", F.element_at(table, F.col("leg_name")))
    known = [c for c in ("multiplier", "delta", "iv", "gamma", "theta", "vega", "dte") if c in legs.columns]
    leg = F.struct("leg_name", "instrument_id", "signed_qty", "strike_price", "right", "expiration", "close", *known)
    marks = rows.groupBy("ts_event").agg(tick_round(F.sum(F.col("signed_qty") * F.col("close")), tick).alias("open_mark"), F.array_sort(F.collect_list(leg)).alias("legs"), F.min("expiration").alias("trade_expiration"), F.min("underlying_id").alias("underlying_id"))
    marks = marks.where(F.size("legs") == len(actions))
    if min_credit is not None:
        marks = marks.where(F.col("open_mark") >= min_credit)
    if max_debit is not None:
        marks = marks.where(F.col("open_mark") >= -abs(max_debit))
    mark = F.col("open_mark")
    levels = {"tp_price": tick_round(take_profit_price(mark, take_profit_pct, take_profit), tick), "sl_price": tick_round(stop_loss_price(mark, stop_loss), tick)}
    return numbered(marks.withColumns(levels).withColumnRenamed("ts_event", "entry_time"), first_id)


def numbered(found: DataFrame, first_id: int = 0) -> DataFrame:
    """Entries with entry_id by time."""
    ids = pnl.with_ids(found.withColumn("_day", F.to_date("entry_time")), ["entry_time"], first_id, "entry_id", "_day")
    return ids.drop("_day").withColumn("entry_id", F.col("entry_id").cast("long"))


def where_all(rows: DataFrame, conditions: Sequence[str]) -> DataFrame:
    """Rows that fulfil every condition; a null condition drops the row."""
    for text in conditions:
        rows = rows.where(compile_condition(text))
    return rows

"""Studies: all combinations of swept values, as few plans over shared tables."""

from __future__ import annotations

import copy
import json
import threading
from collections.abc import Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import kept
from . import backtest
from .strategy import Strategy, Trade, expand_study, load_strategy, load_study, parse_strategy


def read_strategies(path: str | Path) -> list[dict]:
    """The strategies of a study file. A strategy is a path, from the study's folder, to a strategy file, or is written out."""
    folder = Path(path).parent
    study = load_study(Path(path).read_text(encoding="utf-8"))
    found = []
    for item in study["strategies"]:
        place = item if isinstance(item, str) else item.get("path")
        found.append(load_strategy((folder / place).read_text(encoding="utf-8")) if place else item.get("strategy", item))
    return found


def _same_legs(definition: Mapping, name: str) -> str:
    """What the legs of a trade depend on, as text: combinations that agree in it share them."""
    one = copy.deepcopy(dict(definition))
    trade = next(t for t in one["trades"] if t["name"] == name)
    trade["entry"] = {k: v for k, v in trade["entry"].items() if k in ("window", "time_tolerance")}
    trade["legs"] = [{k: v for k, v in leg.items() if k not in ("action", "quantity")} for leg in trade["legs"]]
    return json.dumps({"universe": one.get("universe"), "trade": {k: trade[k] for k in ("instrument", "legs", "entry")}}, sort_keys=True, default=str)


#: Fields whose numbers are thresholds: combinations that differ in these alone share a plan.
_NUMBERS = {"entry": ("min_credit", "max_debit"), "exit": ("stop_loss", "take_profit", "take_profit_pct", "dte_exit", "vega_exit"), "roll": ("dte", "vega")}
_PARTS = ("price", "value", "target", "pct")


def _same_plan(definition: Mapping, name: str) -> str:
    """A trade without its thresholds, and what of the strategy it depends on, as text."""
    trade = copy.deepcopy(next(t for t in definition["trades"] if t["name"] == name))
    for part, names in _NUMBERS.items():
        if trade.get(part) is not None:
            for field in names:
                value = trade[part].pop(field, None)
                rest = {k: v for k, v in value.items() if k not in _PARTS} if isinstance(value, Mapping) else {}
                if rest:
                    trade[part][field] = rest
    return json.dumps({"universe": definition.get("universe"), "costs": definition.get("costs"), "trade": trade}, sort_keys=True, default=str)


class SharedLegs:
    """Legs by what they depend on: the search through all options, a study's largest scan, runs once for all combinations that agree in it. An error is kept, too."""

    def __init__(self, market: dict[str, DataFrame]):
        self.market, self.found, self.lock = market, {}, threading.Lock()

    def _search(self, strategy: Strategy, name: str) -> DataFrame:
        trade = next(t for t in strategy.trades if t.name == name)
        return kept(backtest.find_legs(strategy, trade, self.market, backtest.find_candidates(strategy, trade, self.market)))

    def get(self, definition: Mapping, strategy: Strategy, name: str) -> DataFrame:
        key = _same_legs(definition, name)
        with self.lock:
            mine = key not in self.found
            found = self.found.setdefault(key, Future())
        if mine:
            try:
                found.set_result(self._search(strategy, name))
            except Exception as e:
                found.set_exception(e)
        return found.result()

    def of(self, definition: Mapping, strategy: Strategy) -> dict[str, DataFrame]:
        return {trade.name: self.get(definition, strategy, trade.name) for trade in strategy.trades}


def run_study(strategies: Sequence[Mapping], market: dict[str, DataFrame], max_combinations: int | None = None, workers: int = 4) -> tuple[DataFrame | None, list[dict]]:
    """(positions with combination_id, failed combinations as combination_id and error) of all combinations of all strategies.

    Combinations are checked before the first one runs. Trades that differ in thresholds alone are one plan for all their combinations, with
    these as rows of a table; so a study costs what its different plans cost, and not its combinations. A plan that fails fails its
    combinations and leaves the others alone: their positions aren't there and the error is told. Plans run some at a
    time and share legs; see SharedLegs. Without any result positions are None.
    """
    legs, failed = SharedLegs(market), {}
    plans: dict[tuple[str, str], list[tuple[int, Mapping, Strategy, Trade]]] = {}
    for number, _, definition in expand_study(strategies, max_combinations):
        try:
            strategy = parse_strategy(definition)
            for trade in strategy.trades:
                apart = number if backtest.reads_levels(trade) else ""
                plans.setdefault((trade.name, f"{apart}{_same_plan(definition, trade.name)}"), []).append((number, definition, strategy, trade))
        except Exception as e:  # a combination's fault is its own
            failed[number] = str(e)

    def one(members: list[tuple[int, Mapping, Strategy, Trade]]) -> DataFrame | None:
        number, definition, strategy, trade = members[0]
        try:
            found = legs.get(definition, strategy, trade.name)
            if backtest.reads_levels(trade):
                rows = backtest.run_trade(strategy, trade, market, legs=found).withColumn("combination_id", F.lit(number).cast("long"))
            else:
                rows = backtest.run_shared(strategy, trade, market, {m[0]: backtest.thresholds(m[3]) for m in members}, legs=found)
            return kept(rows)
        except Exception as e:
            failed.update((m[0], str(e)) for m in members)
            return None

    with ThreadPoolExecutor(max_workers=workers) as pool:
        done = [rows for rows in pool.map(one, plans.values()) if rows is not None]
    out = reduce(DataFrame.unionByName, done) if done else None
    if out is not None and failed:  # of a combination with several trades all fail together
        out = out.where(~F.col("combination_id").isin(*failed))
    return out, [{"combination_id": k, "error": failed[k]} for k in sorted(failed)]

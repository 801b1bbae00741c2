"""Strategy and study definitions: fields, defaults and rules."""

from __future__ import annotations

import copy
import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from typing import Any

import yaml

from ..functions.conditions import ConditionError, check_condition


class DefinitionError(ValueError):
    """A strategy or study that breaks a rule."""


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise DefinitionError(message)


def _minutes(hhmm: str) -> int:
    h, m = str(hhmm).split(":")[:2]
    return int(h) * 60 + int(m)


@dataclass
class Session:
    timezone: str = "America/New_York"
    start: str = "09:30"
    end: str = "16:00"
    weekdays_only: bool = True
    skip_dates: list = field(default_factory=list)


@dataclass
class Universe:
    start_date: str = ""
    end_date: str = ""
    session: Session = field(default_factory=Session)
    audit_filter: Any = "hard_errors_only"


@dataclass
class Instrument:
    root_symbol: str
    asset_class: str = "future"
    tick_size: float = 0.0
    expiry_close_time: str | None = None
    roll_days_before_expiry: int = 7

    def __post_init__(self):
        _need(self.asset_class in ("future", "equity", "etf"), f"unknown asset class {self.asset_class}")


@dataclass
class Leg:
    name: str
    right: str
    action: str
    quantity: int = 1
    delta: Any = None
    dte: Any = None
    dte_tolerance: int | None = None
    strike_offset: float | None = None
    reference_leg: str | None = None
    stepped: Any = None
    targets: Any = None

    def __post_init__(self):
        modes = [m for m in ("delta", "strike_offset", "stepped", "targets") if getattr(self, m) is not None]
        _need(len(modes) == 1, f"leg {self.name}: exactly one way of selection")
        _need(self.action in ("sell_to_open", "buy_to_open"), f"leg {self.name}: unknown action")
        _need(self.right in ("C", "P", "call", "put"), f"leg {self.name}: unknown right")
        self.right = self.right[0].upper()
        if self.delta is not None:
            _need(self.dte is not None, f"leg {self.name}: delta needs dte")
            self.delta = _with_tolerance(self.delta, 0.10)
            self.dte = _with_tolerance(self.dte, 5 if self.dte_tolerance is None else self.dte_tolerance)
        if self.strike_offset is not None:
            _need(bool(self.reference_leg), f"leg {self.name}: strike_offset needs reference_leg")
        if self.stepped is not None or self.targets is not None:
            _need(self.dte is None, f"leg {self.name}: dte stands in the steps or targets")
        for ladder in [(self.stepped or {}).get("steps")] + [(self.delta or {}).get("steps") if isinstance(self.delta, Mapping) else None]:
            if ladder is not None:
                _need(bool(ladder), f"leg {self.name}: no steps")
                _need(all(s.get("below") is not None for s in ladder[:-1]), f"leg {self.name}: the step without `below` is the last")
        if self.targets is not None:
            ranks = [t["priority"] for n, t in self.targets.items() if n != "default"]
            _need(bool(ranks) and len(set(ranks)) == len(ranks), f"leg {self.name}: targets need different priorities")
            _need(all(("condition" in t) != (n == "default") and ("priority" in t) != (n == "default") for n, t in self.targets.items()), f"leg {self.name}: default has neither priority nor condition, the others both")


def _with_tolerance(value: Any, tolerance: float) -> Any:
    if isinstance(value, Mapping):
        if "step_source" in value:
            return {"tolerance": tolerance, **value}
        return {"tolerance": tolerance, **value}
    return {"target": value, "tolerance": tolerance}


@dataclass
class Entry:
    window: dict
    conditions: list = field(default_factory=list)
    min_credit: Any = None
    max_debit: Any = None
    max_entries_per_day: int | None = None
    no_reentry_after_loss: bool = False
    time_tolerance: int = 0

    def __post_init__(self):
        _need(_minutes(self.window["start"]) < _minutes(self.window["end"]), "an entry window starts before it ends")
        _check(self.conditions)


@dataclass
class Exit:
    stop_loss: Any = None
    take_profit: Any = None
    take_profit_pct: Any = None
    dte_exit: Any = None
    vega_exit: Any = None
    expiry_exit: bool = True
    conditions: list = field(default_factory=list)
    leg_out: bool = False
    allow_after_hours_exits: bool = False
    on_sl_long_continuation: bool = False
    long_trailing_stop_pct: float = 0.5
    liquidity: dict = field(default_factory=dict)

    def __post_init__(self):
        _need(self.take_profit is None or self.take_profit_pct is None, "take_profit and take_profit_pct exclude each other")
        if self.on_sl_long_continuation:
            _need(self.stop_loss is not None and not self.leg_out, "a continuation needs a stop loss and no leg_out")
            _need(0 < self.long_trailing_stop_pct < 1, "a trailing stop lies between 0 and 1")
        _check(self.conditions)


@dataclass
class Roll:
    window: dict | None = None
    dte: Any = None
    vega: Any = None
    conditions: list = field(default_factory=list)

    def __post_init__(self):
        _need(self.dte is not None or self.vega is not None or bool(self.conditions), "a roll needs a trigger")
        _check(self.conditions)


@dataclass
class Costs:
    slippage_pct: float = 0.0
    fee_per_contract: float = 0.0
    fees: dict | None = None

    def __post_init__(self):
        _need(not (self.fee_per_contract and self.fees), "fee_per_contract and fees exclude each other")

    def per_contract(self) -> tuple[float, float, float]:
        """Fees at entry, exit and expiration; one fee counts half at either end."""
        if self.fees:
            return self.fees.get("entry", 0.0), self.fees.get("exit", 0.0), self.fees.get("expiration", self.fees.get("exit", 0.0))
        return (self.fee_per_contract / 2,) * 3


@dataclass
class Trade:
    name: str
    instrument: Instrument
    legs: list
    entry: Entry
    exit: Exit = field(default_factory=Exit)
    roll: Roll | None = None

    def __post_init__(self):
        names = [x.name for x in self.legs]
        _need(bool(names) and len(set(names)) == len(names), f"trade {self.name}: legs need different names")
        plain = {x.name for x in self.legs if x.strike_offset is None}
        _need(all(x.reference_leg in plain for x in self.legs if x.strike_offset is not None), f"trade {self.name}: a reference leg is another leg without offset")
        _need(sum(x.targets is not None for x in self.legs) <= 1, f"trade {self.name}: one leg with targets at most")


@dataclass
class Strategy:
    name: str
    universe: Universe
    trades: list
    version: str = "1"
    costs: Costs = field(default_factory=Costs)
    matrix: dict = field(default_factory=dict)
    indicators: list = field(default_factory=list)
    combinations: Any = None

    def __post_init__(self):
        names = [t.name for t in self.trades]
        _need(bool(names) and len(set(names)) == len(names), "trades need different names")
        _need(len({t.instrument.root_symbol for t in self.trades}) == 1, "one root symbol per strategy")


def _check(conditions: Sequence[str]) -> None:
    for text in conditions:
        try:
            check_condition(text)
        except ConditionError as e:
            raise DefinitionError(str(e)) from e


def _build(kind, data: Mapping) -> Any:
    known = {f.name for f in fields(kind)}
    unknown = set(data) - known
    _need(not unknown, f"unknown fields of {kind.__name__}: {sorted(unknown)}")
    try:
        return kind(**data)
    except TypeError as e:
        raise DefinitionError(str(e)) from e


def parse_strategy(data: Mapping) -> Strategy:
    """A checked strategy from plain dictionaries (the value under the key `strategy`)."""
    data = copy.deepcopy(dict(data))
    universe = dict(data.get("universe", {}))
    universe["session"] = _build(Session, universe.get("session", {}))
    trades = []
    for t in data.get("trades", []):
        t = dict(t)
        t["instrument"] = _build(Instrument, t.get("instrument", {}))
        t["legs"] = [_build(Leg, x) for x in t.get("legs", [])]
        t["entry"], t["exit"] = _build(Entry, t.get("entry", {})), _build(Exit, t.get("exit", {}))
        t["roll"] = _build(Roll, t["roll"]) if t.get("roll") else None
        trades.append(_build(Trade, t))
    return _build(Strategy, data | {"universe": _build(Universe, universe), "trades": trades, "costs": _build(Costs, data.get("costs", {}))})


def load_strategy(text: str) -> dict:
    """The value under the key `strategy` of a YAML text; sweeps in it aren't expanded yet."""
    data = yaml.safe_load(text)
    _need(isinstance(data, Mapping) and "strategy" in data, "the top key is `strategy`")
    return data["strategy"]


def load_study(text: str) -> dict:
    data = yaml.safe_load(text)
    _need(isinstance(data, Mapping) and "study" in data, "the top key is `study`")
    study = data["study"]
    _need(bool(study.get("strategies")), "a study has one strategy or more")
    return study


def span(start: float, stop: float, step: float) -> list[float]:
    """start, start + step, ... up to and with stop, to 10 decimal places; the step may be negative."""
    _need(step != 0, "a range needs a step")
    n = int((stop - start) / step + 1e-9)
    return [round(start + i * step, 10) for i in range(n + 1)] if n >= 0 else []


#: Fields of a trade that may hold several values or a range, in the order in which sweeps run.
SWEPT = ("entry.min_credit", "entry.max_debit", "exit.stop_loss", "exit.take_profit", "exit.take_profit_pct", "exit.dte_exit", "exit.vega_exit", "roll.dte", "roll.vega")
LEG_SWEPT = ("delta", "dte", "strike_offset", "quantity")


def _choices(value: Any) -> list | None:
    if isinstance(value, Mapping) and {"start", "stop", "step"} <= set(value):
        return span(value["start"], value["stop"], value["step"])
    return list(value) if isinstance(value, list) else None


def _dig(data: Any, path: str) -> Any:
    for part in path.split("."):
        data = data[int(part)] if isinstance(data, list) else (data or {}).get(part)
    return data


def override(data: dict, path: str, value: Any) -> None:
    """Sets the value at a dot path; numbers index lists."""
    *way, last = path.split(".")
    for part in way:
        data = data[int(part)] if isinstance(data, list) else data.setdefault(part, {})
    if isinstance(data, list):
        data[int(last)] = value
    else:
        data[last] = value


def expand(strategy: Mapping, max_combinations: int | None = None, first_id: int = 1) -> list[tuple[int, dict, dict]]:
    """(combination_id, parameters, strategy) of every combination of a strategy's sweeps, checked before any run.

    Axes come in the order of trades and fields, the last varies fastest; explicit `combinations` replace them.
    A null turns a field off.
    """
    strategy = copy.deepcopy(dict(strategy))
    explicit = strategy.pop("combinations", None)
    axes = []
    for i, trade in enumerate(strategy.get("trades", [])):
        paths = [f"trades.{i}.{p}" for p in SWEPT] + [f"trades.{i}.legs.{j}.{f}" for j in range(len(trade.get("legs", []))) for f in LEG_SWEPT]
        for path in paths:
            found = _choices(_dig(strategy, path))
            if found is not None:
                axes.append((path, found))
            elif isinstance(_dig(strategy, path), Mapping) and (inner := _choices(_dig(strategy, path + ".target"))) is not None:
                axes.append((path + ".target", inner))
    _need(not (explicit and axes), "combinations and sweeps exclude each other")
    if explicit:
        rows = [dict(zip(explicit["columns"], r, strict=True)) for r in explicit["rows"]] if isinstance(explicit, Mapping) else list(explicit)
    else:
        rows = [dict(zip([p for p, _ in axes], values, strict=True)) for values in itertools.product(*(v for _, v in axes))]
    limit = max_combinations if max_combinations is not None else strategy.get("matrix", {}).get("max_combinations", 100)
    _need(len(rows) <= limit, f"{len(rows)} combinations, {limit} allowed")
    out = []
    for k, values in enumerate(rows):
        one = copy.deepcopy(strategy)
        for path, value in values.items():
            override(one, path, value)
        parse_strategy(one)
        out.append((first_id + k, values, one))
    return out


def expand_study(strategies: Sequence[Mapping], max_combinations: int | None = None) -> list[tuple[int, dict, dict]]:
    """All combinations of all strategies, numbered through."""
    out: list[tuple[int, dict, dict]] = []
    for s in strategies:
        out += expand(s, max_combinations, len(out) + 1)
    _need(max_combinations is None or len(out) <= max_combinations, f"{len(out)} combinations, {max_combinations} allowed")
    return out

"""Small expressions that several operators share."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column) -> Column:
    """Null counts as false."""
    return F.coalesce(c, F.lit(False))


def any_of(conditions: Sequence[Column]) -> Column:
    """True if one is true; null counts as false, no condition as false."""
    return reduce(lambda a, b: a | b, map(truthy, conditions), F.lit(False))


def tick_round(x: Column, tick: float) -> Column:
    """To the nearest multiple of tick, halves away from zero; tick 0 leaves x alone."""
    return F.round(x / tick) * tick if tick else x


def divide(a: Column, b: Column) -> Column:
    """a / b as IEEE doubles: infinities and NaN for a zero divisor, not an error."""
    zero = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf"))).when(a.isNotNull(), F.lit(float("nan")))
    return F.when(b == 0, zero).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def signed(action: Column, quantity: Column) -> Column:
    """Quantity with + for sold and - for bought legs."""
    return F.when(action.isin("sell_to_open", "STO"), 1).otherwise(-1) * quantity


def no_arbitrage(open_mark: Column, mark: Column) -> Column:
    """A credit position can't be worth less than nothing, a debit position not more."""
    return F.when(open_mark > 0, mark >= 0).when(open_mark < 0, mark <= 0).otherwise(F.lit(True))


def clip_to_bound(open_mark: Column, mark: Column) -> Column:
    """The mark within the bound of no_arbitrage(); null stays null."""
    return F.when(mark.isNull(), None).when((open_mark > 0) & (mark < 0), 0.0).when((open_mark < 0) & (mark > 0), 0.0).otherwise(mark)


def intrinsic(right: Column, spot: Column, strike: Column) -> Column:
    """max(0, S - K) for calls, max(0, K - S) for puts; null without a spot."""
    gain = F.when(right == "C", spot - strike).otherwise(strike - spot)
    return F.when(gain < 0, 0.0).otherwise(gain)


def take_profit_price(open_mark: Column, pct: float | None = None, price: float | None = None) -> Column:
    if pct is not None:
        return open_mark * (1 - pct)
    return open_mark - price if price is not None else F.lit(None).cast("double")


def stop_loss_price(open_mark: Column, loss: float | None) -> Column:
    return open_mark + loss if loss is not None else F.lit(None).cast("double")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def contract_root(symbol: Column) -> Column:
    """Letters and digits before a month code and year digits, as ES of ESM6; empty if it is no such symbol."""
    return F.regexp_extract(symbol, r"^([A-Z0-9]+?)[FGHJKMNQUVXZ]\d{1,2}$", 1)


#: Parts of the names of indicators that a chart shows in a panel of their own.
PANEL_WORDS = ("rsi", "atr", "adx", "stoch", "macd", "mom", "roc", "cci", "willr", "obv", "volatility", "zscore", "z_score", "ves", "percentile", "rank")


def placement(name: Column) -> Column:
    """Where a chart shows an indicator: panel, or overlay on the prices (also for null)."""
    return F.when(F.lower(name).rlike("|".join(PANEL_WORDS)), "panel").otherwise("overlay")


def sum_horizontal(*columns: Column) -> Column:
    """Sum of a row's columns, null as 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in columns))

"""Reads of stored bars: filters and columns that reach the parquet scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLUMNS = ("ts_event", "open", "high", "low", "close", "volume")


def one(bars: DataFrame, instrument_id: int, start: str | None = None, end: str | None = None, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """An instrument's bars in order of time, both ends inclusive."""
    rows = bars.where(F.col("instrument_id") == instrument_id)
    rows = rows.where(F.col("ts_event") >= F.lit(start).cast("timestamp_ntz")) if start else rows
    rows = rows.where(F.col("ts_event") <= F.lit(end).cast("timestamp_ntz")) if end else rows
    return rows.select(*columns).orderBy("ts_event")


def many(bars: DataFrame, ids: DataFrame, columns: Sequence[str] = COLUMNS) -> DataFrame:
    """The bars (or vegas, by `columns`) of all instruments in ids, in no order."""
    return bars.join(ids.select("instrument_id"), "instrument_id", "left_semi").select("instrument_id", *columns)


def underlying_of(option_bars: DataFrame) -> DataFrame:
    return option_bars.select("instrument_id", "underlying_id").distinct()


def by_root(bars: DataFrame, root: str) -> DataFrame:
    """Bars whose symbol begins with root. A short root fits longer ones, too: E fits ES and EW."""
    return bars.where(F.col("symbol").startswith(root))

"""Indicator series: user functions, tall storage, wide use."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling(column: str, n: int, kind: str = "avg", keys: Sequence[str] = ("instrument_id",)) -> Column:
    """Rolling mean, sample deviation, minimum, maximum or sum of n rows; null until there are n values."""
    frame = Window.partitionBy(*keys).orderBy("ts_event").rowsBetween(-(n - 1), 0)
    how = {"avg": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}[kind]
    return F.when(F.count(column).over(frame) == n, how(column).over(frame))


def run(bars: DataFrame, compute: Callable, context=None) -> DataFrame:
    """(instrument_id, ts_event, name, value) of the columns that a user's compute(bars[, context]) adds; nulls are left out."""
    given = inspect.signature(compute).parameters
    out = compute(bars, context) if len(given) > 1 else compute(bars)
    new = [c for c in out.columns if c not in bars.columns]
    return out.unpivot(["instrument_id", "ts_event"], [F.col(c).cast("double").alias(c) for c in new], "name", "value").where(F.col("value").isNotNull())


def run_pandas(bars: DataFrame, compute: Callable, names: Sequence[str]) -> DataFrame:
    """run() for a function of one instrument's pandas frame, sorted by time."""
    schema = "instrument_id long, ts_event timestamp_ntz, " + ", ".join(f"`{n}` double" for n in names)
    wide = bars.groupBy("instrument_id").applyInPandas(lambda rows: compute(rows.sort_values("ts_event"))[["instrument_id", "ts_event", *names]], schema)
    return wide.unpivot(["instrument_id", "ts_event"], list(names), "name", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))


def with_definitions(values: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all definitions, values with indicator_id): unknown (name, instrument) pairs get the next ids, in that order."""
    pairs = values.select("name", F.col("instrument_id").alias("underlying_id")).distinct()
    new = pairs.join(definitions, ["name", "underlying_id"], "left_anti")
    top = definitions.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("_top"))
    new = new.withColumn("_n", F.row_number().over(Window.orderBy("name", "underlying_id"))).join(F.broadcast(top)).withColumn("id", F.col("_top") + F.col("_n"))
    every = definitions.select("id", "name", "underlying_id").unionByName(new.select("id", "name", "underlying_id"))
    joined = values.withColumnRenamed("instrument_id", "underlying_id").join(every, ["name", "underlying_id"])
    return every, joined.select("ts_event", F.col("id").alias("indicator_id"), "value")


def insert_absent(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    return incoming.join(stored.select("indicator_id", "ts_event"), ["indicator_id", "ts_event"], "left_anti")


def replace_window(stored: DataFrame, recomputed: DataFrame, start, end) -> DataFrame:
    """The stored series with [start, end] taken from the recomputed one."""
    inside = F.col("ts_event").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return stored.where(~inside).unionByName(recomputed.where(inside).select(*stored.columns))


def recompute(stored: DataFrame, bars: DataFrame, compute: Callable, underlying_id: int, start, end, tail_days: int) -> DataFrame:
    """The stored series (instrument_id, ts_event, name, value) after a back-fill of one contract's bars in [start, end].

    compute() is fed the bars from tail_days before the start, which warm up its windows, to tail_days after the end, whose
    windows reach back into the gap. What it gives from the start to the end of that tail replaces what was stored there.
    """
    at = lambda day, n: F.timestamp_add("DAY", F.lit(n), F.lit(day).cast("timestamp_ntz")).cast("timestamp_ntz")
    ts, own = F.col("ts_event"), F.col("instrument_id") == underlying_id
    fed = bars.where(own & ts.between(at(start, -tail_days), at(end, tail_days)))
    inside = own & ts.between(at(start, 0), at(end, tail_days))
    fresh = run(fed, compute).where(inside)
    names = fresh.select("name").distinct().withColumn("_new", F.lit(True))
    old = stored.join(F.broadcast(names), "name", "left").where(~(inside & F.coalesce("_new", F.lit(False))))
    return old.select(*stored.columns).unionByName(fresh.select(*stored.columns))


def stale(values: DataFrame, definitions: DataFrame, bars: DataFrame) -> DataFrame:
    """Definitions whose newest value is older than their instrument's newest bar, or missing."""
    newest = values.groupBy(F.col("indicator_id").alias("id")).agg(F.max("ts_event").alias("_v"))
    bar = bars.groupBy(F.col("instrument_id").alias("underlying_id")).agg(F.max("ts_event").alias("_b"))
    return definitions.join(newest, "id", "left").join(bar, "underlying_id").where(F.col("_v").isNull() | (F.col("_v") < F.col("_b"))).select(*definitions.columns)


def wide(values: DataFrame, definitions: DataFrame, names: Sequence[str]) -> DataFrame:
    """One column per stated name, one row per contract and time, over all contracts."""
    named = values.join(definitions, values["indicator_id"] == definitions["id"]).select("ts_event", "underlying_id", "name", "value")
    return named.groupBy("underlying_id", "ts_event").pivot("name", list(names)).agg(F.first("value"))


def option_context(options: DataFrame, dte: tuple[int, int] | None = None, delta: tuple[float, float] | None = None, right: str | None = None) -> DataFrame:
    """The options an indicator asks for; right may be C, P, call or put."""
    if dte:
        options = options.where(F.col("dte").between(*dte))
    if delta:
        options = options.where(F.col("delta").between(*delta))
    return options.where(F.col("right") == right[0].upper()) if right else options

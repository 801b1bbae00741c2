"""As-of joins: bounded backward, session-wide fill, nearest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import epoch_micros, epoch_seconds


def backward_bounded(left: DataFrame, right: DataFrame, by: Sequence[str], values: Sequence[str], bound_seconds: int, ts: str = "ts_event", lag: str = "lag_s") -> DataFrame:
    """Each left row with the latest right row of its key at or before it, no older than the bound; others are dropped.

    One window over the union of both sides, so a dense right side doesn't multiply rows. Time is cut into stretches as
    long as the bound, and right rows are also there in the next one, so a key with many rows is spread over tasks.
    `lag` tells the age of the match in whole seconds. Right rows that share key and time: the largest values win.
    """
    a = left.select(*by, ts, F.struct(*(F.col(c) for c in left.columns)).alias("_l"), F.lit(1).alias("_side"), _cell(F.col(ts), bound_seconds).alias("_cell"))
    b = right.select(*by, ts, F.lit(0).alias("_side"), F.struct(F.col(ts).alias("_t"), *values).alias("_r"), _copies(F.col(ts), bound_seconds, (0, 1)).alias("_cell"))
    order = Window.partitionBy(*by, "_cell").orderBy(F.col(ts), F.col("_side"), F.col("_r")).rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_m", F.last("_r", ignorenulls=True).over(order))
    found = both.where((F.col("_side") == 1) & F.col("_m").isNotNull()).withColumn(lag, F.floor(epoch_seconds(F.col(ts)) - epoch_seconds(F.col("_m._t"))).cast("int"))
    exact = epoch_micros(F.col(ts)) - epoch_micros(F.col("_m._t"))
    return found.where(exact <= bound_seconds * 1_000_000).select("_l.*", *(F.col(f"_m.{v}").alias(v if v not in left.columns else f"{v}_right") for v in values), lag)


def _cell(ts: Column, seconds: int) -> Column:
    """The number of the stretch of time that holds an instant."""
    return F.floor(epoch_seconds(ts) / max(1, seconds)).cast("long")


def _copies(ts: Column, seconds: int, near: Sequence[int]) -> Column:
    """One row for its own stretch and each of those near it."""
    cell = _cell(ts, seconds)
    return F.explode(F.array(*(cell + d for d in near)))


def session_fill(left: DataFrame, right: DataFrame, session: Column, values: Sequence[str], by: Sequence[str] = (), ts: str = "ts_event") -> DataFrame:
    """Adds to each left row the last non-null value of each column at or before it in its session; null before the first.

    Each column is filled by itself, and nothing is carried from one session to the next. A value that is named like a
    column of the left side comes as <name>_right.
    """
    hidden = {v: f"_value{i}" for i, v in enumerate(values)}
    a = left.withColumns({"_side": F.lit(1)})
    b = right.select(*by, ts, *(F.col(v).alias(h) for v, h in hidden.items()), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_session", session)
    order = Window.partitionBy(*by, "_session").orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumns({h: F.last(h, ignorenulls=True).over(order) for h in hidden.values()}).where("_side = 1")
    return filled.select(*left.columns, *(F.col(h).alias(v if v not in left.columns else f"{v}_right") for v, h in hidden.items()))


def nearest(left: DataFrame, right: DataFrame, by: Sequence[str], values: Sequence[str], tolerance_seconds: int, ts: str = "ts_event") -> DataFrame:
    """Each left row with the right row of its key that is nearest in time within the tolerance; others are dropped.

    Tolerance 0 is an equi-join. Otherwise two windows over the union of both sides find the last right row up to, and
    the first one after, each left row; repeated left rows stay as often as they are there. Time is cut into stretches as
    in backward_bounded(). Equally near: the earlier one. Right rows that share key and time: the largest values win.
    """
    if tolerance_seconds == 0:
        return left.join(right.select(*by, ts, *values), [*by, ts])
    a = left.select(*by, ts, F.struct(*(F.col(c) for c in left.columns)).alias("_l"), F.lit(1).alias("_side"), _cell(F.col(ts), tolerance_seconds).alias("_cell"))
    b = right.select(*by, ts, F.lit(0).alias("_side"), F.struct(F.col(ts).alias("_t"), *values).alias("_r"), _copies(F.col(ts), tolerance_seconds, (-1, 0, 1)).alias("_cell"))
    keys, past = Window.partitionBy(*by, "_cell"), (Window.unboundedPreceding, 0)
    up, down = (keys.orderBy(t, F.col("_side"), F.col("_r")).rowsBetween(*past) for t in (F.col(ts), F.col(ts).desc()))
    both = a.unionByName(b, allowMissingColumns=True).withColumns({"_a": F.last("_r", ignorenulls=True).over(up), "_b": F.last("_r", ignorenulls=True).over(down)})
    gap = lambda side: F.abs(epoch_micros(F.col(ts)) - epoch_micros(F.col(f"{side}._t")))
    found = both.where("_side = 1").withColumn("_m", F.when(F.col("_b").isNull() | (gap("_a") <= gap("_b")), F.col("_a")).otherwise(F.col("_b")))
    return found.where(gap("_m") <= tolerance_seconds * 1_000_000).select("_l.*", *(F.col(f"_m.{v}").alias(v) for v in values))

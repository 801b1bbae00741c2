"""Which of the found positions a strategy could really hold: one at a time, daily caps, no re-entry after a loss."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Entries of a walk beyond which it is a grouped pandas function: the native fold copies what it keeps.
FOLD_LIMIT = 10_000


def with_walks(positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds _walk and _size: each key's stretches of days that can be walked by themselves, and their numbers of entries.

    A stretch begins on a day before whose first entry all earlier gates have passed. Only one row per key and day
    takes part in the search for them.
    """
    days = positions.groupBy(*keys, "day").agg(F.min("entry_time").alias("_first"), F.max("gate_time").alias("_gate"), F.count("*").alias("_n"))
    order = Window.partitionBy(*keys).orderBy("day")
    cut = F.coalesce(F.max("_gate").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("_first"), F.lit(True))
    walks = days.withColumn("_cut", cut).withColumn("_walk", F.sum(F.col("_cut").cast("int")).over(order))
    walks = walks.withColumn("_size", F.sum("_n").over(Window.partitionBy(*keys, "_walk"))).select(*(F.col(k).alias(f"_of_{k}") for k in keys), F.col("day").alias("_of_day"), "_walk", "_size")
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in (*keys, "day")]
    return positions.join(walks, on).select(*positions.columns, "_walk", "_size")


def greedy_walk(positions: DataFrame, keys: Sequence[str], max_per_day: int | None = None, one_at_a_time: bool = True) -> DataFrame:
    """The positions that are kept when walking each key by (entry_time, entry_id).

    A position is skipped while an earlier kept one is open (its gate_time is later than the entry), and when its
    day is full. One re-entry right after a roll on the same day doesn't count for the cap. A null gate_time
    never blocks. positions has entry_id, entry_time, gate_time, exit_reason and day.

    A key is walked in the stretches of with_walks(): short ones by a native fold, those of more than FOLD_LIMIT entries by
    a grouped function.
    """
    rows, walk = with_walks(positions, keys), [*keys, "_walk"]
    short = _fold(rows.where(F.col("_size") <= FOLD_LIMIT), walk, max_per_day, one_at_a_time)
    long = greedy_walk_grouped(rows.where(F.col("_size") > FOLD_LIMIT), walk, max_per_day, one_at_a_time)
    return short.unionByName(long).select(*positions.columns)


def _fold(positions: DataFrame, keys: Sequence[str], max_per_day: int | None, one_at_a_time: bool) -> DataFrame:
    """The walk as a fold over each group's sorted entries."""
    item = F.struct(F.col("entry_time").alias("t"), F.col("entry_id").alias("id"), F.col("gate_time").alias("gate"), (F.col("exit_reason") == "roll").alias("roll"), F.col("day").alias("day"))
    groups = positions.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))
    kind = positions.select(item.alias("i")).schema["i"].dataType
    stamp, day = kind["t"].dataType.simpleString(), kind["day"].dataType.simpleString()
    empty = F.struct(F.lit(None).cast(stamp).alias("gate"), F.lit(None).cast(day).alias("day"), F.lit(0).alias("n"), F.lit(False).alias("free"), F.array().cast("array<bigint>").alias("kept"))

    def step(acc, x):
        same = F.coalesce(acc["day"] == x["day"], F.lit(False))
        n, free = F.when(same, acc["n"]).otherwise(0), same & acc["free"]
        clear = acc["gate"].isNull() | (x["t"] >= acc["gate"]) if one_at_a_time else F.lit(True)
        room = (n < max_per_day) | free if max_per_day is not None else F.lit(True)
        kept = F.struct(x["gate"].alias("gate"), x["day"].alias("day"), F.when(free, n).otherwise(n + 1).alias("n"), F.coalesce(x["roll"], F.lit(False)).alias("free"), F.concat(acc["kept"], F.array(x["id"].cast("bigint"))).alias("kept"))
        return F.when(clear & room, kept).otherwise(acc)

    kept = groups.select(*keys, F.explode(F.aggregate("_items", empty, step, lambda a: a["kept"])).alias("entry_id"))
    return positions.join(kept, [*keys, "entry_id"], "left_semi")


def greedy_walk_grouped(positions: DataFrame, keys: Sequence[str], max_per_day: int | None = None, one_at_a_time: bool = True) -> DataFrame:
    """greedy_walk() as one pass over each key's rows in a grouped function."""

    def walk(rows):
        rows = rows.sort_values(["entry_time", "entry_id"])
        keep, gate, day, n, free = [], None, None, 0, False
        for t, g, d, reason in zip(rows["entry_time"], rows["gate_time"], rows["day"], rows["exit_reason"], strict=True):
            if d != day:
                n_here, free_here = 0, False
            else:
                n_here, free_here = n, free
            clear = not one_at_a_time or gate is None or t >= gate
            room = max_per_day is None or n_here < max_per_day or free_here
            keep.append(clear and room)
            if keep[-1]:
                gate, day, n, free = None if pd.isna(g) else g, d, n_here if free_here else n_here + 1, reason == "roll"
        return rows[keep]

    return positions.groupBy(*keys).applyInPandas(walk, positions.schema)


def no_reentry_after_loss(positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Drops what enters a day after the first stop loss of that day closed."""
    day = Window.partitionBy(*keys, "day")
    loss = F.min(F.when(F.col("exit_reason") == "stop_loss", F.col("exit_time"))).over(day)
    return positions.withColumn("_loss", loss).where(F.col("_loss").isNull() | (F.col("entry_time") <= F.col("_loss"))).drop("_loss")


def daily_cap(positions: DataFrame, keys: Sequence[str], max_per_day: int) -> DataFrame:
    """The first entries of each day; the entry right after a roll doesn't count."""
    order = Window.partitionBy(*keys, "day").orderBy("entry_time", "entry_id")
    counts = F.when(F.lag("exit_reason").over(order) == "roll", 0).otherwise(1)
    rows = positions.withColumn("_c", counts)
    return rows.withColumn("_n", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_n") <= max_per_day).drop("_c", "_n")


def gate_times(exits: DataFrame, continuations: DataFrame, open_time: str = "09:30", zone: str = "UTC", weekdays_only: bool = True, skip_dates: Sequence[str] = ()) -> DataFrame:
    """Adds gate_time: after a stop loss with a long leg left, the later of its end and the next trading day's session open on the zone's clock, else the exit."""
    ends = continuations.groupBy("entry_id").agg(F.max("exit_time").alias("_end"))
    day = F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("exit_time")))
    trades = lambda d: (F.weekday(d) < 5 if weekdays_only else F.lit(True)) & ~d.cast("string").isin(*map(str, skip_dates or ["-"]))
    following = F.element_at(F.filter(F.transform(F.sequence(F.lit(1), F.lit(4 + 3 * len(skip_dates))), lambda i: F.date_add(day, i)), trades), 1)
    opening = F.convert_timezone(F.lit(zone), F.lit("UTC"), F.to_timestamp_ntz(F.concat(following.cast("string"), F.lit(f" {open_time}:00")), F.lit("yyyy-MM-dd HH:mm:ss")))
    return exits.join(ends, "entry_id", "left").withColumn("gate_time", F.when(F.col("_end").isNotNull(), F.greatest("_end", opening)).otherwise(F.col("exit_time"))).drop("_end")

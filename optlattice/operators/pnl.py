"""Pass 3: profit and loss of closed positions, and the rows that are stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profit(entries: DataFrame, exits: DataFrame, multiplier: float | Column, slippage_pct: float = 0.0, fee_entry: float = 0.0, fee_exit: float = 0.0, fee_expiry: float | None = None) -> DataFrame:
    """entries with exits: gross_pnl, slippage_cost, fee_cost and net_pnl. Positions that were never marked are dropped.

    The multiplier is a number or a column of the entries. Slippage is a share of the absolute exit mark, for settlements too. Fees are per contract, at entry and at exit or expiry.
    """
    rows = entries.join(exits, "entry_id")
    contracts = F.aggregate("legs", F.lit(0.0), lambda a, x: a + F.abs(x["signed_qty"]))
    closing = F.when(F.col("exit_reason") == "expiry", fee_exit if fee_expiry is None else fee_expiry).otherwise(fee_exit)
    rows = rows.withColumns({"gross_pnl": (F.col("open_mark") - F.col("exit_mark")) * multiplier, "slippage_cost": F.abs("exit_mark") * multiplier * slippage_pct, "fee_cost": (closing + fee_entry) * contracts})
    return rows.withColumn("net_pnl", F.col("gross_pnl") - F.col("slippage_cost") - F.col("fee_cost"))


def leg_rows(positions: DataFrame) -> DataFrame:
    """One row per position and leg; a leg's exit price isn't known."""
    legs = positions.select("entry_id", F.posexplode("legs").alias("leg_index", "l"))
    action = F.when(F.col("l.signed_qty") > 0, "STO").otherwise("BTO")
    return legs.select("entry_id", "leg_index", F.col("l.leg_name").alias("leg_name"), F.col("l.instrument_id").alias("instrument_id"), action.alias("action"), F.abs("l.signed_qty").alias("quantity"), F.col("l.strike_price").alias("strike_price"), F.col("l.right").alias("right"), F.col("l.expiration").alias("expiration"), F.col("l.close").alias("entry_price"), F.lit(None).cast("double").alias("exit_price"))


def continuation_pnl(found: DataFrame, multiplier: float, quantity: Column | None = None) -> DataFrame:
    return found.withColumn("pnl", (F.col("exit_price") - F.col("entry_price")) * multiplier * (F.lit(1) if quantity is None else quantity))


def with_ids(rows: DataFrame, order: list[str], first: int = 1, name: str = "id", bucket: str | None = None) -> DataFrame:
    """Adds consecutive ids in an order.

    With `bucket` (a column whose values are in that order, such as the date) rows are counted per bucket first
    and ranked inside it, so no task holds all rows.
    """
    if bucket is None:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1 + first)
    counts = rows.groupBy(bucket).count()
    before = counts.select(bucket, F.coalesce(F.sum("count").over(Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(bucket).orderBy(*order))
    return rows.withColumn("_n", within).join(before, bucket).withColumn(name, F.col("_n") + F.col("_before") - 1 + first).drop("_n", "_before")

"""Bounds that a position's profit can't leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread_widths(legs: DataFrame) -> DataFrame:
    """(position_id, width): the widest distance between a sold and a bought leg of the same right."""
    side = lambda action, name: legs.where(F.col("action") == action).select("position_id", "right", F.col("strike_price").alias(name))
    pairs = side("STO", "sold").join(side("BTO", "bought"), ["position_id", "right"])
    return pairs.groupBy("position_id").agg(F.max(F.abs(F.col("sold") - F.col("bought"))).alias("width"))


def open_marks(legs: DataFrame) -> DataFrame:
    """(position_id, leg_mark): the open mark again, from the legs."""
    signed = F.when(F.col("action") == "STO", 1).otherwise(-1) * F.col("quantity")
    return legs.groupBy("position_id").agg(F.sum(signed * F.col("entry_price")).alias("leg_mark"))


def violations(positions: DataFrame, legs: DataFrame, multiplier: float, tolerance: float = 0.01) -> DataFrame:
    """Positions that break a bound, with the broken ones joined by ' | ', the largest profits first."""
    rows = positions.join(spread_widths(legs), positions["id"] == F.col("position_id"), "left").drop("position_id").join(open_marks(legs), positions["id"] == F.col("position_id"), "left").drop("position_id")
    gross, credit, width = F.col("gross_pnl"), F.col("open_mark"), F.col("width")
    checks = {
        "gain_above_credit": (credit > 0) & (gross > credit * multiplier + tolerance),
        "loss_above_width": (credit > 0) & (gross < (credit - width) * multiplier - tolerance),
        "gain_above_width": (credit < 0) & (gross > (width + credit) * multiplier + tolerance),
        "loss_above_debit": (credit < 0) & (gross < credit * multiplier - tolerance),
        "exit_mark_sign": ((credit > 0) & (F.col("exit_mark") < -tolerance)) | ((credit < 0) & (F.col("exit_mark") > tolerance)),
        "pnl_identity": F.abs((credit - F.col("exit_mark")) * multiplier - gross) > tolerance,
    }
    named = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks.items())))
    return rows.withColumn("violations", F.array_join(named, " | ")).where("violations <> ''").orderBy(F.abs("gross_pnl").desc(), "id")


def summary(found: DataFrame) -> DataFrame:
    """(violation, n, gross_pnl)."""
    each = found.select(F.explode(F.split("violations", r" \| ")).alias("violation"), "gross_pnl")
    return each.groupBy("violation").agg(F.count("*").alias("n"), F.sum("gross_pnl").alias("gross_pnl"))

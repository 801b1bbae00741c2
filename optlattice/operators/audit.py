"""Data-quality flags over bars and greeks, and the filter that uses them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pricing
from .ranks import kept, medians, tiles

#: Severity of each flag. Hard flags mean that the data are wrong, soft ones that they are doubtful.
SEVERITY = {
    "IV_NAN": "soft",
    "IV_SENTINEL": "soft",
    "IV_HIGH": "soft",
    "DELTA_INCONSISTENT": "soft",
    "BARS_TRUNCATED": "hard",
    "BARS_SPARSE": "soft",
    "NO_EXPIRY_BARS": "soft",
    "NEGATIVE_CLOSE": "hard",
    "NEGATIVE_DTE": "hard",
    "ZOMBIE_BAR": "hard",
    "DELTA_SIGN_ERROR": "hard",
    "DELTA_MAGNITUDE_ERROR": "hard",
}
#: Limits of the rules.
IV_LIMIT, IV_TOP, DELTA_GAP, TRUNCATED_SHARE, SPARSE_BARS = 2.0, 10.0, 0.10, 0.15, 10.0


def _rule(code: str, when: Column, value: Column, threshold: float | None, phase: int) -> Column:
    """A flag where the rule holds, else null."""
    return F.when(when, F.struct(F.lit(code).alias("flag_code"), F.lit(SEVERITY[code]).alias("flag_severity"), value.cast("double").alias("flag_value"), F.lit(threshold).cast("double").alias("threshold"), F.lit(phase).alias("phase")))


def _emit(rows: DataFrame, rules: Sequence[Column]) -> DataFrame:
    """One row per flag: all rules are checked in one pass over the rows."""
    stamp = F.col("ts_event") if "ts_event" in rows.columns else F.lit(None).cast("timestamp_ntz")
    return rows.select("instrument_id", stamp.alias("ts_event"), F.explode(F.array_compact(F.array(*rules))).alias("_f")).select("instrument_id", "ts_event", "_f.*")


def _iv_rules() -> list[Column]:
    iv = F.col("iv")
    return [_rule("IV_NAN", F.isnan(iv), iv, None, 1), _rule("IV_SENTINEL", iv == IV_TOP, iv, IV_TOP, 1), _rule("IV_HIGH", (iv > IV_LIMIT) & ~F.isnan(iv) & (iv != IV_TOP), iv, IV_LIMIT, 1)]


def _greek_rules() -> list[Column]:
    delta = F.col("delta")
    return [_rule("NEGATIVE_DTE", F.col("dte") < 0, F.col("dte"), 0.0, 4), _rule("DELTA_MAGNITUDE_ERROR", (F.abs(delta) > 1) & ~F.isnan(delta), delta, 1.0, 4)]


def _sign_rules() -> list[Column]:
    delta = F.col("delta")
    wrong = ((F.col("right") == "P") & (delta > 0)) | ((F.col("right") == "C") & (delta < 0))
    return [_rule("DELTA_SIGN_ERROR", wrong & ~F.isnan(delta), delta, 0.0, 4)]


def _gap_rules() -> list[Column]:
    theory = pricing.greeks(F.col("spot"), F.col("strike_price"), F.col("T"), F.col("iv"), F.col("right"))["delta"]
    gap = F.abs(F.col("delta") - theory)
    return [F.transform(F.array(gap), lambda g: _rule("DELTA_INCONSISTENT", (g > DELTA_GAP) & ~F.isnan(g), g, DELTA_GAP, 2))[0]]


def _bar_rules() -> list[Column]:
    late = F.datediff("expiration", F.to_date("ts_event"))
    return [_rule("NEGATIVE_CLOSE", F.col("close") < 0, F.col("close"), 0.0, 4), _rule("ZOMBIE_BAR", late < 0, late, 0.0, 4)]


def _with_bars(greeks: DataFrame, option_bars: DataFrame, underlying_bars: DataFrame | None = None) -> DataFrame:
    """Greeks with their option bar's strike and right and their underlying's close, null where there is none."""
    rows = greeks.join(option_bars.select("instrument_id", "ts_event", "strike_price", "right"), ["instrument_id", "ts_event"], "left")
    if underlying_bars is None:
        return rows
    spot = underlying_bars.select(F.col("instrument_id").alias("underlying_id"), "ts_event", F.col("close").alias("spot"))
    return rows.join(spot, ["underlying_id", "ts_event"], "left")


def iv_flags(greeks: DataFrame) -> DataFrame:
    return _emit(greeks, _iv_rules())


def delta_flags(greeks: DataFrame, option_bars: DataFrame, underlying_bars: DataFrame) -> DataFrame:
    """Deltas that a recomputation from the underlying's bar of the same time contradicts."""
    return _emit(_with_bars(greeks, option_bars, underlying_bars), _gap_rules())


def coverage_flags(option_bars: DataFrame) -> DataFrame:
    """Contracts whose bars end early, are few a day, or are missing on the expiration date."""
    day = F.to_date("ts_event")
    per = option_bars.groupBy("instrument_id", "expiration").agg(F.min(day).alias("a"), F.max(day).alias("b"), F.count("*").alias("n"), F.countDistinct(day).alias("days"), F.count_if(day == F.col("expiration")).alias("last_day"))
    share = F.datediff("expiration", "b") / F.nullif(F.datediff("expiration", "a"), F.lit(0))
    rate = F.col("n") / F.col("days")
    return _emit(per, [_rule("BARS_TRUNCATED", share > TRUNCATED_SHARE, share, TRUNCATED_SHARE, 3), _rule("BARS_SPARSE", rate < SPARSE_BARS, rate, SPARSE_BARS, 3), _rule("NO_EXPIRY_BARS", F.col("last_day") == 0, F.col("last_day"), None, 3)])


def integrity_flags(option_bars: DataFrame, greeks: DataFrame) -> DataFrame:
    return _emit(option_bars, _bar_rules()).unionByName(_emit(_with_bars(greeks, option_bars), _greek_rules() + _sign_rules()))


def run(option_bars: DataFrame, greeks: DataFrame, underlying_bars: DataFrame) -> DataFrame:
    """All flags, in one pass over the greeks with their bars, one over the bars and one over the contracts; of equal instrument, time and code the earlier phase stays."""
    rows = _with_bars(greeks, option_bars, underlying_bars)
    flags = _emit(rows, _iv_rules() + _gap_rules() + _greek_rules() + _sign_rules()).unionByName(coverage_flags(option_bars)).unionByName(_emit(option_bars, _bar_rules()))
    first = F.min(F.struct("phase", "flag_value", "flag_severity", "threshold")).alias("f")
    return flags.groupBy("instrument_id", "ts_event", "flag_code").agg(first).select("instrument_id", "ts_event", "flag_code", "f.flag_severity", "f.flag_value", "f.threshold")


def flag_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("flag_code", "flag_severity").agg(F.count("*").alias("n"), F.countDistinct("instrument_id").alias("n_instruments"))


def codes(preset: str | Sequence[str]) -> list[str] | None:
    """The codes that a filter drops: all hard ones, all, none, or a list; an unknown preset drops nothing."""
    if not isinstance(preset, str):
        return list(preset)
    return {"hard_errors_only": [c for c, s in SEVERITY.items() if s == "hard"], "all": list(SEVERITY)}.get(preset)


def drop_flagged(rows: DataFrame, flags: DataFrame | None, preset: str | Sequence[str]) -> DataFrame:
    """Rows of instruments without any of the filter's flags; without flags or filter all rows."""
    drop = codes(preset)
    if flags is None or not drop:
        return rows
    return rows.join(flags.where(F.col("flag_code").isin(drop)).select("instrument_id").distinct(), "instrument_id", "left_anti")


def quintiles(greeks: DataFrame, option_bars: DataFrame, flags: DataFrame) -> DataFrame:
    """Per right and fifth of the first delta: its range, exact median, instruments, and how many are flagged."""
    first = greeks.where(~F.isnan("delta")).groupBy("instrument_id").agg(F.min_by("delta", "ts_event").alias("first_delta"))
    rights = option_bars.groupBy("instrument_id").agg(F.min("right").alias("right"))
    rows = tiles(kept(first.join(rights, "instrument_id")), ["right"], "first_delta", "instrument_id", 5).withColumnRenamed("tile", "quintile")
    flagged = flags.select(F.col("instrument_id").alias("_f")).distinct()
    rows = kept(rows.join(flagged, rows["instrument_id"] == flagged["_f"], "left"))
    by = ["right", "quintile"]
    out = rows.groupBy(*by).agg(F.min("first_delta").alias("low"), F.max("first_delta").alias("high"), F.count("*").alias("n"), F.count("_f").alias("n_flagged"))
    return out.join(medians(rows, by, "first_delta", "median"), by).select(*by, "low", "high", "median", "n", "n_flagged")

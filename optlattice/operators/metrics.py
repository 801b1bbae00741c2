"""Trade statistics, equity, drawdown and confidence intervals. positions has id, open_time, exit_time, net_pnl and marks."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import minute_number
from .ranks import kept, medians

#: Trading days of a year, for annual figures.
YEAR_DAYS = 252


def trade_stats(positions: DataFrame, keys: Sequence[str] = ("backtest_id",)) -> DataFrame:
    """Counts, sums, means, win rate and mean duration (in minute boundaries) per key. A profit of 0 is no win and no loss."""
    pnl = F.col("net_pnl")
    win, loss = F.when(pnl > 0, pnl), F.when(pnl < 0, pnl)
    minutes = minute_number(F.col("exit_time")) - minute_number(F.col("open_time"))
    return positions.groupBy(*keys).agg(
        F.count("*").alias("n_trades"),
        F.sum(pnl).alias("total_pnl"),
        F.avg(pnl).alias("avg_pnl"),
        F.count(win).alias("n_wins"),
        F.count(loss).alias("n_losses"),
        (F.count(win) / F.count("*")).alias("win_rate"),
        F.coalesce(F.sum(win), F.lit(0.0)).alias("gross_win"),
        F.coalesce(F.sum(loss), F.lit(0.0)).alias("gross_loss"),
        F.avg(win).alias("avg_win"),
        F.avg(loss).alias("avg_loss"),
        F.avg(minutes).alias("avg_minutes"),
        F.min(F.to_date("open_time")).alias("first_date"),
        F.max(F.to_date("exit_time")).alias("last_date"),
    )


def metrics_block(positions: DataFrame, keys: Sequence[str] = ("backtest_id",)) -> DataFrame:
    """Profit factor, exact median, adverse excursion (worst mark against open mark) and premium capture per key."""
    pnl = F.col("net_pnl")
    gain, loss = F.sum(F.when(pnl > 0, pnl)), F.sum(F.when(pnl < 0, pnl))
    adverse = F.col("worst_mark") - F.col("open_mark")
    out = positions.groupBy(*keys).agg(
        (gain / F.nullif(-loss, F.lit(0.0))).alias("profit_factor"),
        F.avg(adverse).alias("avg_adverse"),
        F.max(adverse).alias("max_adverse"),
        (F.sum(F.col("open_mark") - F.col("exit_mark")) / F.nullif(F.sum(F.abs("open_mark")), F.lit(0.0))).alias("premium_capture"),
    )
    values = kept(positions.select(*keys, pnl.alias("_pnl"), adverse.alias("_adverse")))
    for value, name in (("_pnl", "median_pnl"), ("_adverse", "median_adverse")):
        found = medians(values, keys, value, name)
        out = out.join(found, [out[k].eqNullSafe(found[k]) for k in keys]).drop(*(found[k] for k in keys))
    return out.select(*keys, "profit_factor", "median_pnl", "avg_adverse", "median_adverse", "max_adverse", "premium_capture")


def _block(column: str) -> Column:
    """The day of an instant, by which long series are cut; rows without one come first, as they sort."""
    return F.coalesce(F.to_date(column), F.lit("0001-01-01").cast("date"))


def _offsets(blocks: DataFrame, keys: Sequence[str], block: str, **totals: Column) -> DataFrame:
    """Adds to blocks, one row for each key and day, what the earlier blocks of the key come to."""
    past = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumns({name: total.over(past) for name, total in totals.items()})


def equity(positions: DataFrame, initial: float, keys: Sequence[str] = ("backtest_id",)) -> DataFrame:
    """Positions with trade_no (by open time), equity after each exit, its running peak, and the drawdown from it.

    Prefix scans in two levels: running figures within each key and day, and one row a day whose sums and maxima are carried on to
    the days after it. No task holds a key's whole history. Keys are never null.
    """
    keys = list(keys)
    base = positions.withColumns({"_o": _block("open_time"), "_x": _block("exit_time")})
    here = Window.partitionBy(*keys, "_x").orderBy("exit_time", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = base.withColumn("_s", F.sum("net_pnl").over(here))
    days = rows.groupBy(*keys, "_x").agg(F.sum("net_pnl").alias("_total"), F.max("_s").alias("_top"))
    days = _offsets(days, keys, "_x", _sum=F.sum("_total")).withColumn("_sum", F.coalesce("_sum", F.lit(0.0)))
    days = _offsets(days.withColumn("_high", F.col("_sum") + F.col("_top")), keys, "_x", _peak=F.max("_high")).select(*keys, "_x", "_sum", "_peak")
    rows = rows.join(days, [*keys, "_x"]).withColumn("equity", F.col("_s") + F.col("_sum") + initial)
    peak = F.greatest(F.lit(float(initial)), F.col("_peak") + initial, F.max("equity").over(here))
    rows = rows.withColumn("peak", peak).withColumn("drawdown", F.col("peak") - F.col("equity"))
    opened = _offsets(base.groupBy(*keys, "_o").agg(F.count("*").alias("_n")), keys, "_o", _before=F.sum("_n")).drop("_n")
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_o").orderBy("open_time", "id"))).join(opened, [*keys, "_o"])
    number = (F.coalesce("_before", F.lit(0)) + F.col("_r")).cast("int")
    return rows.select(*(F.col(c) for c in positions.columns), number.alias("trade_no"), "equity", "peak", "drawdown")


def max_drawdown(curve: DataFrame, keys: Sequence[str] = ("backtest_id",)) -> DataFrame:
    """(keys, max_drawdown, peak_at_max, max_drawdown_pct, final_equity); of equal drawdowns the earliest counts."""
    worst = F.max_by("peak", F.struct("drawdown", -F.col("trade_no")))
    last = F.max_by("equity", F.struct("exit_time", "id"))
    return curve.groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"), worst.alias("peak_at_max"), (F.max("drawdown") / worst).alias("max_drawdown_pct"), last.alias("final_equity"))


def daily_pnl(positions: DataFrame, keys: Sequence[str] = ("backtest_id",), day: str = "open_time") -> DataFrame:
    return positions.groupBy(*keys, F.to_date(day).alias("day")).agg(F.sum("net_pnl").alias("pnl"), F.count("*").alias("n"))


def dense_days(daily: DataFrame, keys: Sequence[str] = ("backtest_id",), weekdays_only: bool = True) -> DataFrame:
    """Every day between the first and the last of each key, days without trades with a profit of 0."""
    span = daily.groupBy(*keys).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(*keys, F.explode(F.sequence("a", "b")).alias("day"))
    days = days.where(F.weekday("day") < 5) if weekdays_only else days
    return days.join(daily, [*keys, "day"], "left").withColumn("pnl", F.coalesce("pnl", F.lit(0.0)))


def ratios(days: DataFrame, keys: Sequence[str] = ("backtest_id",)) -> DataFrame:
    """Mean, sample deviation, downside sample deviation, Sharpe and Sortino of daily profits; null where a deviation is 0 or missing."""
    pnl = F.col("pnl")
    out = days.groupBy(*keys).agg(F.avg(pnl).alias("mean_day"), F.stddev_samp(pnl).alias("std_day"), F.stddev_samp(F.when(pnl < 0, pnl)).alias("down_day"))
    ratio = lambda d: F.col("mean_day") / F.nullif(F.col(d), F.lit(0.0)) * math.sqrt(YEAR_DAYS)
    return out.withColumns({"sharpe": ratio("std_day"), "sortino": ratio("down_day")})


def growth(initial: Column, final: Column, days: Column, drawdown_pct: Column) -> dict[str, Column]:
    """cagr and calmar (cagr over the largest relative drawdown); null where time or capital isn't positive."""
    cagr = F.when((days > 0) & (initial > 0) & (final > 0), F.pow(final / initial, F.lit(365.25) / days) - 1)
    return {"cagr": cagr, "calmar": cagr / F.nullif(drawdown_pct, F.lit(0.0))}


def wilson(wins: Column, n: Column, z: float = 1.959963984540054) -> dict[str, Column]:
    """The Wilson interval of a share of wins; null without trials."""
    p = wins / F.nullif(n, F.lit(0))
    middle = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return {"win_low": middle - half, "win_high": middle + half}


#: Start of the random stream of resampled figures.
SEED = 99999


#: Draws of a task's block, steps of a path that are summed up together, and lanes apart of a block.
BLOCK_DRAWS, BLOCK_STEPS, LANE = 2_000_000, 4_096, 1_024
#: Tasks at most that share a key's resamples, profits that are sent together, and profits of a key that a task holds.
SHARES, PIECE, SLICE = 8, 65_536, 8_388_608


def _step(s: np.ndarray) -> np.ndarray:
    """The next states of the xorshift stream (13, 17, 5) of signed 32-bit integers."""
    s = s ^ (s << np.uint32(13))
    s = s ^ (s.view(np.int32) >> np.int32(17)).view(np.uint32)
    return s ^ (s << np.uint32(5))


def _times(matrix: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix of bits, as the images of the single bits, applied to states."""
    bits = (s[..., None] >> np.arange(32, dtype=np.uint32)) & np.uint32(1)
    return np.bitwise_xor.reduce(np.where(bits == 1, matrix, np.uint32(0)), axis=-1)


@lru_cache(maxsize=1)
def _powers() -> list[np.ndarray]:
    """The matrices of 1, 2, 4, ... steps: a step only shifts and adds bits without carry, so it is linear."""
    out = [_step(np.uint32(1) << np.arange(32, dtype=np.uint32))]
    for _ in range(62):
        out.append(_times(out[-1], out[-1]))
    return out


def _ahead(steps: int) -> np.ndarray:
    """The matrix of so many steps."""
    out = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for k, matrix in enumerate(_powers()):
        if steps >> k & 1:
            out = _times(matrix, out)
    return out


def streams(count: int, n: int, first: int = 0, stride: int = 0, seed: int = SEED) -> np.ndarray:
    """`count` rows of n numbers of the stream, as shares of 2^32: the first row from the number `first` on, each next one `stride` later.

    Rows are cut into lanes that go on at once, so a block anywhere in the stream costs what it holds.
    """
    lane = max(1, min(n, LANE, int(math.sqrt(count * n))))
    per = -(-n // lane)
    state = _times(_ahead(first), np.array([seed & 0xFFFFFFFF], dtype=np.uint32))
    lanes, row_step, lane_step = np.empty((count, per), dtype=np.uint32), _ahead(stride), _ahead(lane)
    for k in range(count):
        lanes[k, :1] = state
        state = _times(row_step, state)
    for k in range(1, per):
        lanes[:, k] = _times(lane_step, lanes[:, k - 1])
    out, lanes = np.empty((lane, count * per), dtype=np.uint32), lanes.reshape(-1)
    for k in range(lane):
        lanes = _step(lanes)
        out[k] = lanes
    return np.ascontiguousarray(out.T).reshape(count, per * lane)[:, :n] / 2.0**32


def stream(n: int, seed: int = SEED, first: int = 0) -> np.ndarray:
    """n numbers of the stream from the number `first` on."""
    return streams(1, n, first, seed=seed)[0]


def _taken(x: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """The values that draws take."""
    return x[np.minimum((shares * len(x)).astype(np.int64), len(x) - 1)]


def _series(positions: DataFrame, keys: Sequence[str], times: int) -> tuple[DataFrame, Column]:
    """(keys, x, n): a key's profits by exit time and id; and how many resamples a task draws."""
    one = F.struct("exit_time", "id", "net_pnl")
    rows = positions.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(one)), lambda r: r["net_pnl"].cast("double")).alias("x"))
    rows = rows.withColumn("n", F.size("x").cast("long"))
    return rows, F.greatest(F.lit(1), F.least(F.lit(times), F.floor(F.lit(BLOCK_DRAWS) / F.col("n")))).cast("long")


def _kinds(rows: DataFrame, keys: Sequence[str], more: str) -> str:
    return ", ".join([*(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys), more])


def _placed(positions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _j, _n, _pnl): each profit with its place from 0 on by exit time and id, and how many its key has; numbered by days."""
    rows = positions.select(*keys, "exit_time", "id", F.col("net_pnl").cast("double").alias("_pnl"), _block("exit_time").alias("_x"))
    days = rows.groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    days = _offsets(days, keys, "_x", _before=F.sum("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy(*keys)))
    here = F.row_number().over(Window.partitionBy(*keys, "_x").orderBy("exit_time", "id"))
    same = lambda left, right: [left[c].eqNullSafe(right[c]) for c in (*keys, "_x")]
    out = (left := rows.withColumn("_r", here)).join(days, same(left, days))
    return out.select(*(left[k] for k in keys), (F.coalesce("_before", F.lit(0)) + F.col("_r") - 1).alias("_j"), "_n", "_pnl")


def _drawn_sum(x: np.ndarray, n: int, begin: int, path: int) -> float:
    """The sum of what the draws of one resample of n take of the slice x that begins at a place."""
    total = 0.0
    for at in range(0, n, BLOCK_DRAWS):
        j = np.minimum((stream(min(BLOCK_DRAWS, n - at), first=path * n + at) * n).astype(np.int64), n - 1)
        if len(x) < n:
            j = j[(j >= begin) & (j < begin + len(x))] - begin
        total += float(x[j].sum())
    return total


def bootstrap_mean(positions: DataFrame, keys: Sequence[str] = ("backtest_id",), n_boot: int = 1000, level: float = 0.95) -> DataFrame:
    """(keys, mean_low, mean_high): percentile interval of the mean profit.

    A key's trades by exit time and id are resampled n_boot times by the stream, each time as many as there are. A key's resamples are
    shared out to SHARES tasks at most, so its profits are sent no oftener, in pieces of PIECE. A task holds at most SLICE of a key's profits
    and a block of draws; of a longer series each task draws the whole stream of its resamples and sums up what falls into its slice.
    """
    keys = list(keys)
    placed = _placed(positions, keys)
    piece = placed.groupBy(*keys, F.expr(f"_j div {PIECE}").alias("_piece")).agg(F.max("_n").alias("_n"), F.transform(F.array_sort(F.collect_list(F.struct("_j", "_pnl"))), lambda r: r["_pnl"]).alias("x"))
    shares = F.least(F.lit(SHARES), F.greatest(F.lit(1), F.ceil(F.col("_n") * n_boot / BLOCK_DRAWS)), F.lit(n_boot)).cast("int")
    sent = piece.withColumns({"_slice": F.expr(f"_piece div {SLICE // PIECE}"), "_shares": shares}).withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))

    def sums(key, rows):
        names, (share, part) = list(key[:-2]), key[-2:]
        rows = rows.sort_values("_piece")
        n, x = int(rows["_n"].iloc[0]), np.concatenate([np.asarray(v, dtype=float) for v in rows["x"]])
        begin, of = int(part) * SLICE, int(rows["_shares"].iloc[0])
        first, last = n_boot * int(share) // of, n_boot * (int(share) + 1) // of
        total = np.array([_drawn_sum(x, n, begin, path) for path in range(first, last)])
        return pd.DataFrame({k: [v] * len(total) for k, v in zip(keys, names, strict=True)} | {"path": np.arange(first, last), "total": total, "n": n})

    parts = sent.groupBy(*keys, "_share", "_slice").applyInPandas(sums, _kinds(positions, keys, "path long, total double, n long"))
    found = parts.groupBy(*keys, "path").agg((F.sum("total") / F.max("n")).alias("mean"))
    share = [(1 - level) / 2, (1 + level) / 2]
    return found.groupBy(*keys).agg(*(F.percentile("mean", F.lit(q)).alias(c) for q, c in zip(share, ("mean_low", "mean_high"), strict=True)))


def equity_fan(positions: DataFrame, keys: Sequence[str] = ("backtest_id",), paths: int = 120, initial: float = 0.0) -> DataFrame:
    """(keys, step, p5, p25, p50, p75, p95): quantiles (by index floor(n p)) of resampled equity paths after each step from 1 on.

    Paths follow each other in the stream. First tasks draw some paths each and sum up blocks of steps; then tasks draw a block of
    steps of all paths again, from where the earlier blocks end. A task holds a key's profits and one block of draws.
    """
    keys = list(keys)
    rows, per = _series(positions, keys, paths)
    shared = rows.withColumn("per", per).withColumn("path", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(paths - 1).cast("long"), F.col("per")))).repartition(*keys, "path")

    def sums(batches):
        for batch in batches:
            for at, row in enumerate(batch.itertuples(index=False)):
                x, first, last = np.asarray(row.x), row.path, min(paths, row.path + row.per)
                drawn = _taken(x, stream((last - first) * len(x), first=first * len(x))).reshape(last - first, len(x))
                total = np.add.reduceat(drawn, np.arange(0, len(x), BLOCK_STEPS), axis=1)
                path, block = np.divmod(np.arange(total.size), total.shape[1])
                yield batch.iloc[[at] * total.size][keys].reset_index(drop=True).assign(path=first + path, block=block, total=total.reshape(-1))

    blocks = shared.mapInPandas(sums, _kinds(rows, keys, "path long, block long, total double"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy(*keys, "path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    begins = blocks.withColumn("before", before).groupBy(*keys, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "before"))), lambda r: r["before"]).alias("before"))
    wanted = begins.join(rows, keys)

    def fan(batches):
        for batch in batches:
            for at, row in enumerate(batch.itertuples(index=False)):
                x, first = np.asarray(row.x), row.block * BLOCK_STEPS
                size = min(BLOCK_STEPS, len(x) - first)
                drawn = _taken(x, streams(paths, size, first, len(x)))
                curves = np.sort(np.cumsum(drawn, axis=1) + np.asarray(row.before)[:, None] + initial, axis=0)
                out = batch.iloc[[at] * size][keys].reset_index(drop=True).assign(step=np.arange(first + 1, first + size + 1))
                yield out.assign(**{f"p{p}": curves[int(paths * p / 100)] for p in (5, 25, 50, 75, 95)})

    return wanted.mapInPandas(fan, _kinds(rows, keys, "step long, p5 double, p25 double, p50 double, p75 double, p95 double"))


def study_table(positions: DataFrame, initial: float) -> DataFrame:
    """One row per backtest with statistics, ratios, drawdown and intervals: single passes over all backtests."""
    stats = trade_stats(positions)
    worst = max_drawdown(equity(positions, initial))
    days = ratios(dense_days(daily_pnl(positions)))
    out = stats.join(worst, "backtest_id").join(days, "backtest_id")
    length = F.datediff("last_date", "first_date")
    return out.withColumns({**growth(F.lit(float(initial)), F.col("final_equity"), length, F.col("max_drawdown_pct")), **wilson(F.col("n_wins"), F.col("n_trades")), "recovery_factor": F.col("total_pnl") / F.nullif(F.col("max_drawdown"), F.lit(0.0))})

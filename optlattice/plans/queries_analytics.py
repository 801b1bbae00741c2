"""Queries on closed trades, charts, studies and result tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import explore, metrics, validate
from ..operators.ranks import kept, shared_folder
from ..sources import files, results
from ..sources.cache import ResultCache
from . import fixtures as fx
from .queries_market import T
from .registry import Registry
from .strategy import expand

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
_TR = fx.TRADES


def rounded(df, digits, *columns):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@R.add(f"""WITH {_TR} SELECT backtest_id, count(*) AS n_trades, round(sum(net_pnl), 4) AS total_pnl, round(avg(net_pnl), 6) AS avg_pnl, count(*) FILTER (net_pnl > 0) AS n_wins, count(*) FILTER (net_pnl < 0) AS n_losses, round(count(*) FILTER (net_pnl > 0) / count(*), 8) AS win_rate,
round(coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0), 4) AS gross_win, round(coalesce(sum(net_pnl) FILTER (net_pnl < 0), 0), 4) AS gross_loss, round(avg(net_pnl) FILTER (net_pnl > 0), 6) AS avg_win, round(avg(net_pnl) FILTER (net_pnl < 0), 6) AS avg_loss,
round(avg(date_diff('minute', open_time, exit_time)), 4) AS avg_minutes, CAST(CAST(min(open_time) AS DATE) AS VARCHAR) AS first_date, CAST(CAST(max(exit_time) AS DATE) AS VARCHAR) AS last_date FROM trades GROUP BY 1""")
def trade_stats(spark, sf_dir):
    """A12, A18"""
    out = metrics.trade_stats(fx.trades(spark, sf_dir))
    out = rounded(out, 4, "total_pnl", "gross_win", "gross_loss")
    out = rounded(rounded(out, 6, "avg_pnl", "avg_win", "avg_loss"), 4, "avg_minutes").withColumn("win_rate", F.round("win_rate", 8))
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")})


@R.add(f"""WITH {_TR} SELECT backtest_id, round(sum(net_pnl) FILTER (net_pnl > 0) / NULLIF(-sum(net_pnl) FILTER (net_pnl < 0), 0), 6) AS profit_factor, round(quantile_cont(net_pnl, 0.5), 5) AS median_pnl, round(avg(worst_mark - open_mark), 7) AS avg_adverse,
round(quantile_cont(worst_mark - open_mark, 0.5), 4) AS median_adverse, round(max(worst_mark - open_mark), 4) AS max_adverse, round(sum(open_mark - exit_mark) / NULLIF(sum(abs(open_mark)), 0), 6) AS premium_capture FROM trades GROUP BY 1""")
def metrics_block(spark, sf_dir):
    """A20"""
    out = metrics.metrics_block(fx.trades(spark, sf_dir))
    out = rounded(out, 6, "profit_factor", "premium_capture")
    return rounded(rounded(rounded(out, 4, "median_adverse", "max_adverse"), 7, "avg_adverse"), 5, "median_pnl")


_EQUITY = f"""{_TR}, eq AS (SELECT *, row_number() OVER (PARTITION BY backtest_id ORDER BY open_time, id) AS trade_no, 1000000 + sum(net_pnl) OVER w AS equity FROM trades WINDOW w AS (PARTITION BY backtest_id ORDER BY exit_time, id ROWS UNBOUNDED PRECEDING)),
pk AS (SELECT *, greatest(1000000.0, max(equity) OVER (PARTITION BY backtest_id ORDER BY exit_time, id ROWS UNBOUNDED PRECEDING)) AS peak FROM eq)"""


@R.add(f"WITH {_EQUITY} SELECT backtest_id, id, trade_no, round(equity, 4) AS equity, round(peak, 4) AS peak, round(peak - equity, 4) AS drawdown FROM pk")
def equity_curve(spark, sf_dir):
    """W8-W10, W15"""
    out = metrics.equity(fx.trades(spark, sf_dir), 1_000_000)
    return rounded(out, 4, "equity", "peak", "drawdown").select("backtest_id", "id", F.col("trade_no").cast("long").alias("trade_no"), "equity", "peak", "drawdown")


@R.add(f"""WITH {_EQUITY} SELECT backtest_id, round(max(peak - equity), 4) AS max_drawdown, round(arg_max(peak, peak - equity), 4) AS peak_at_max, round(max(peak - equity) / arg_max(peak, peak - equity), 8) AS max_drawdown_pct, round(arg_max(equity, {{'t': exit_time, 'i': id}}), 4) AS final_equity FROM pk GROUP BY 1""")
def max_drawdown(spark, sf_dir):
    """A15, K19"""
    out = metrics.max_drawdown(metrics.equity(fx.trades(spark, sf_dir), 1_000_000))
    return rounded(out, 4, "max_drawdown", "peak_at_max", "final_equity").withColumn("max_drawdown_pct", F.round("max_drawdown_pct", 8))


_DAYS = f"""{_TR}, dp AS (SELECT backtest_id, CAST(open_time AS DATE) AS day, sum(net_pnl) AS pnl, count(*) AS n FROM trades GROUP BY 1, 2),
span AS (SELECT backtest_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS d FROM dp GROUP BY backtest_id), dense AS (SELECT s.backtest_id, CAST(d AS DATE) AS day, coalesce(pnl, 0) AS pnl FROM span s LEFT JOIN dp ON dp.backtest_id = s.backtest_id AND dp.day = CAST(d AS DATE) WHERE isodow(d) < 6)"""


@R.add(f"WITH {_DAYS} SELECT backtest_id, CAST(day AS VARCHAR) AS day, round(pnl, 4) AS pnl, n FROM dp")
def daily_pnl(spark, sf_dir):
    """A13, A17"""
    out = metrics.daily_pnl(fx.trades(spark, sf_dir))
    return rounded(out, 4, "pnl").withColumn("day", F.col("day").cast("string"))


@R.add(f"""WITH {_DAYS} SELECT backtest_id, round(avg(pnl), 4) AS mean_day, round(stddev_samp(pnl), 4) AS std_day, round(stddev_samp(pnl) FILTER (pnl < 0), 4) AS down_day, round(avg(pnl) / stddev_samp(pnl) * sqrt(252), 6) AS sharpe,
round(avg(pnl) / (stddev_samp(pnl) FILTER (pnl < 0)) * sqrt(252), 6) AS sortino, count(*) AS n_days FROM dense GROUP BY 1""")
def daily_ratios(spark, sf_dir):
    """J24, A14, A21"""
    days = metrics.dense_days(metrics.daily_pnl(fx.trades(spark, sf_dir)))
    out = metrics.ratios(days).join(days.groupBy("backtest_id").agg(F.count("*").alias("n_days")), "backtest_id")
    return rounded(rounded(out, 4, "mean_day", "std_day", "down_day"), 6, "sharpe", "sortino")


@R.add(f"""WITH {_TR}, d AS (SELECT backtest_id, CAST(exit_time AS DATE) AS day, sum(net_pnl) AS pnl FROM trades GROUP BY 1, 2) SELECT backtest_id, round(avg(pnl) / stddev_samp(pnl) * sqrt(252), 6) AS sharpe FROM d GROUP BY 1""")
def active_day_sharpe(spark, sf_dir):
    """A21 by exit date"""
    return rounded(metrics.ratios(metrics.daily_pnl(fx.trades(spark, sf_dir), day="exit_time")), 6, "sharpe").select("backtest_id", "sharpe")


@R.add(f"""WITH {_EQUITY}, s AS (SELECT backtest_id, count(*) AS n, count(*) FILTER (net_pnl > 0) AS w, sum(net_pnl) AS p, max(peak - equity) AS dd, max(peak - equity) / arg_max(peak, peak - equity) AS ddp, arg_max(equity, {{'t': exit_time, 'i': id}}) AS f,
CAST(max(exit_time) AS DATE) - CAST(min(open_time) AS DATE) AS days FROM pk GROUP BY 1), q AS (SELECT *, w / n AS r, 1.959963984540054 AS z FROM s)
SELECT backtest_id, round(CASE WHEN days > 0 AND f > 0 THEN (f / 1000000) ** (365.25 / days) - 1 END, 8) AS cagr, round(CASE WHEN days > 0 AND f > 0 THEN ((f / 1000000) ** (365.25 / days) - 1) / NULLIF(ddp, 0) END, 6) AS calmar, round(p / NULLIF(dd, 0), 6) AS recovery_factor,
round((r + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(r * (1 - r) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS win_low, round((r + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(r * (1 - r) / n + z * z / (4 * n * n)) / (1 + z * z / n), 6) AS win_high FROM q""")
def study_table(spark, sf_dir):
    """A22, A23, A25, A33"""
    out = metrics.study_table(fx.trades(spark, sf_dir), 1_000_000)
    return rounded(rounded(out, 6, "calmar", "recovery_factor", "win_low", "win_high"), 8, "cagr").select("backtest_id", "cagr", "calmar", "recovery_factor", "win_low", "win_high")


#: The random stream, the trades by place, and which trade each step of each resample takes.
_DRAWS = f"""{_TR}, t AS MATERIALIZED (SELECT backtest_id, net_pnl, row_number() OVER (PARTITION BY backtest_id ORDER BY exit_time, id) - 1 AS j, count(*) OVER (PARTITION BY backtest_id) AS n FROM trades),
top AS MATERIALIZED (SELECT max(n) AS n FROM t),
r(i, s, z) AS (SELECT CAST(0 AS BIGINT), CAST(99999 AS BIGINT), n * {{times}} FROM top UNION ALL SELECT i + 1, xor(s, (s << 5) & 4294967295), z FROM (SELECT i, z, xor(s, CASE WHEN s >= 2147483648 THEN (s >> 17) | 4294934528 ELSE s >> 17 END) AS s FROM (SELECT i, z, xor(s, (s << 13) & 4294967295) AS s FROM r WHERE i < z) a) b),
d AS (SELECT k.backtest_id, p, i.i, CAST(floor(r.s / 4294967296.0::DOUBLE * n) AS BIGINT) AS j FROM (SELECT DISTINCT backtest_id, n FROM t) k, (SELECT unnest(range({{times}})) AS p) p, (SELECT unnest(range((SELECT n FROM top))) AS i) i JOIN r ON r.i = p * n + i.i + 1 WHERE i.i < n)"""


@R.add(f"WITH RECURSIVE {_DRAWS.format(times=200)}, m AS (SELECT d.backtest_id, p, avg(net_pnl) AS m FROM d JOIN t USING (backtest_id, j) GROUP BY 1, 2) SELECT backtest_id, round(quantile_cont(m, 0.025), 4) AS mean_low, round(quantile_cont(m, 0.975), 4) AS mean_high FROM m GROUP BY 1")
def bootstrap_mean(spark, sf_dir):
    """A24"""
    return rounded(metrics.bootstrap_mean(fx.trades(spark, sf_dir), n_boot=200), 4, "mean_low", "mean_high")


@R.add(f"""WITH RECURSIVE {_DRAWS.format(times=120)}, c AS (SELECT d.backtest_id, d.i, sum(net_pnl) OVER (PARTITION BY d.backtest_id, p ORDER BY d.i) AS e FROM d JOIN t USING (backtest_id, j)), q AS (SELECT backtest_id, i + 1 AS step, list_sort(list(e)) AS e FROM c GROUP BY 1, 2)
SELECT backtest_id, step, round(e[7], 4) AS p5, round(e[31], 4) AS p25, round(e[61], 4) AS p50, round(e[91], 4) AS p75, round(e[115], 4) AS p95 FROM q""")
def equity_fan(spark, sf_dir):
    """A28"""
    return rounded(metrics.equity_fan(fx.trades(spark, sf_dir)), 4, "p5", "p25", "p50", "p75", "p95")


@R.add(f"WITH {_TR}, p AS (SELECT backtest_id, backtest_id % 2 AS x, backtest_id // 2 AS y, round(sum(net_pnl), 4) AS m FROM trades GROUP BY 1) SELECT y, max(CASE WHEN x = 0 THEN m END) AS \"0\", max(CASE WHEN x = 1 THEN m END) AS \"1\" FROM p GROUP BY 1")
def heatmap(spark, sf_dir):
    """K22"""
    return explore.heatmap(_grid(spark, sf_dir), "x", "y", "m", [0, 1])


def _grid(spark, sf_dir):
    return fx.trades(spark, sf_dir).groupBy("backtest_id").agg(F.round(F.sum("net_pnl"), 4).alias("m")).withColumns({"x": F.col("backtest_id") % 2, "y": F.expr("backtest_id div 2")})


R.add(ORACLE_SQL["heatmap"], "heatmap_whole")(heatmap)


@R.add(f"WITH {_DAYS}, f AS (SELECT date_trunc('week', min(day)) AS f FROM dp) SELECT backtest_id, CAST(day AS VARCHAR) AS day, CAST(floor((day - CAST(f AS DATE)) / 7) AS INTEGER) AS week, CAST(isodow(day) - 1 AS INTEGER) AS weekday FROM dp, f")
def calendar(spark, sf_dir):
    """K23"""
    return explore.calendar(metrics.daily_pnl(fx.trades(spark, sf_dir))).select("backtest_id", F.col("day").cast("string").alias("day"), "week", "weekday")


@R.add(f"WITH {_DAYS} SELECT backtest_id, CAST(day AS VARCHAR) AS day, round(pnl, 4) AS pnl FROM dp WHERE backtest_id = 3 ORDER BY dp.pnl, dp.day LIMIT 20")
def worst_days(spark, sf_dir):
    """The report of one backtest's 20 worst days"""
    d = metrics.daily_pnl(fx.trades(spark, sf_dir).where("backtest_id = 3"))
    return explore.worst_days(d).select("backtest_id", F.col("day").cast("string").alias("day"), F.round("pnl", 4).alias("pnl"))


@R.add(f"WITH {_TR} SELECT id, backtest_id FROM trades WHERE CAST(id AS VARCHAR) LIKE '%1%' AND backtest_id >= 2 AND backtest_id <= 6 ORDER BY id LIMIT 50 OFFSET 100")
def result_page(spark, sf_dir):
    """A page of the grid, filtered by a text in one column and a range of another"""
    return explore.page(fx.trades(spark, sf_dir).select("id", "backtest_id"), ["id"], 100, 50, {"id": "1", "backtest_id": (2, 6)})


@R.add(f"WITH {_TR}, m AS (SELECT backtest_id, round(avg(net_pnl) / stddev_samp(net_pnl), 8) AS sharpe FROM trades GROUP BY 1) SELECT * FROM m ORDER BY coalesce(sharpe, -1e308) DESC, backtest_id LIMIT 1")
def best_backtest(spark, sf_dir):
    """T7, T9"""
    m = fx.trades(spark, sf_dir).groupBy("backtest_id").agg(F.round(F.avg("net_pnl") / F.stddev_samp("net_pnl"), 8).alias("sharpe"))
    return explore.best_backtest(m)


@R.add(f"WITH {_TR} SELECT backtest_id, round(count(*) * 0.5 + sum(open_mark) * 2 - max(exit_mark), 4) AS score FROM trades GROUP BY 1")
def composite_score(spark, sf_dir):
    """P42"""
    m = fx.trades(spark, sf_dir).groupBy("backtest_id").agg(F.count("*").alias("n"), F.sum("open_mark").alias("o"), F.max("exit_mark").alias("x"))
    return m.select("backtest_id", F.round(explore.composite({"n": 0.5, "o": 2.0, "x": -1.0}), 4).alias("score"))


@R.add("SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, round((max(o_totalprice) - (SELECT max(o_totalprice) FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT min(CAST(o_orderdate AS DATE)) FROM orders))) * 2, 2) AS pnl FROM orders GROUP BY CAST(o_orderdate AS DATE)")
def buy_and_hold(spark, sf_dir):
    """S20"""
    prices = fx.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.max("o_totalprice").alias("close"))
    return explore.buy_and_hold(prices, 2.0).withColumn("date", F.col("date").cast("string"))


@R.add(f"WITH {_TR} SELECT count(*) || ':' || max(id) || ':' || CAST(CAST(round(sum(backtest_id), 2) AS DECIMAL(38, 2)) AS VARCHAR) AS fingerprint FROM trades")
def cache_fingerprint(spark, sf_dir):
    """A29, S28"""
    return explore.fingerprint(fx.trades(spark, sf_dir), value_col="backtest_id")


@R.add("WITH p AS (SELECT p_partkey % 5 AS delta, p_partkey % 1 AS tp, p_partkey % 7 AS dte FROM part) SELECT 'delta' AS name, count(DISTINCT delta) AS n_values FROM p UNION ALL SELECT 'dte', count(DISTINCT dte) FROM p")
def swept_axes(spark, sf_dir):
    """A32"""
    k = F.col("p_partkey")
    return explore.swept(fx.table(spark, sf_dir, "part").select((k % 5).alias("delta"), (k % 1).alias("tp"), (k % 7).alias("dte")), ["delta", "tp", "dte"])


_LEGS = f"""{_TR}, legs AS (SELECT id AS position_id, id % 8 AS instrument_id, 'STO' AS action, 1 AS quantity, 'P' AS r, 100.0 + id % 40 AS k, open_mark + 1 AS p FROM trades UNION ALL SELECT id, (id + 1) % 8, 'BTO', 1, 'P', 90.0 + id % 30, 1.0 FROM trades)"""


def _legs(t):
    one = t.select(F.col("id").alias("position_id"), (F.col("id") % 8).alias("instrument_id"), F.lit("STO").alias("action"), F.lit(1).alias("quantity"), F.lit("P").alias("right"), (100.0 + F.col("id") % 40).alias("strike_price"), (F.col("open_mark") + 1).alias("entry_price"))
    two = t.select(F.col("id").alias("position_id"), ((F.col("id") + 1) % 8).alias("instrument_id"), F.lit("BTO").alias("action"), F.lit(1).alias("quantity"), F.lit("P").alias("right"), (90.0 + F.col("id") % 30).alias("strike_price"), F.lit(1.0).alias("entry_price"))
    return one.unionByName(two)


@R.add(f"""WITH {_LEGS}, x AS (SELECT id, open_mark, exit_mark, CASE WHEN id % 11 = 0 THEN 0 ELSE round((open_mark - exit_mark) * 50, 4) END AS g, abs((100.0 + id % 40) - (90.0 + id % 30)) AS w FROM trades),
v AS (SELECT g, CASE WHEN open_mark > 0 AND g > open_mark * 50 + 0.01 THEN 'gain_above_credit' END AS a, CASE WHEN open_mark > 0 AND g < (open_mark - w) * 50 - 0.01 THEN 'loss_above_width' END AS b, CASE WHEN open_mark > 0 AND exit_mark < -0.01 THEN 'exit_mark_sign' END AS c, CASE WHEN abs((open_mark - exit_mark) * 50 - g) > 0.01 THEN 'pnl_identity' END AS d FROM x),
u AS (SELECT g, unnest([a, b, c, d]) AS violation FROM v) SELECT violation, count(*) AS n, round(sum(g), 4) AS gross_pnl FROM u WHERE violation IS NOT NULL GROUP BY 1""")
def pnl_violations(spark, sf_dir):
    """K20, A26, A27, J26, T6"""
    t = kept(fx.trades(spark, sf_dir)).withColumn("gross_pnl", F.when(F.col("id") % 11 == 0, 0.0).otherwise(F.round((F.col("open_mark") - F.col("exit_mark")) * 50, 4)))
    return rounded(validate.summary(validate.violations(t, _legs(t), 50.0)), 4, "gross_pnl")


@R.add(f"""WITH {_LEGS} SELECT DISTINCT t.id FROM trades t JOIN legs ON legs.position_id = t.id WHERE legs.instrument_id IN (0, 1, 2) AND open_time < TIMESTAMP '1998-01-01' AND exit_time >= TIMESTAMP '1996-01-01'""")
def chart_overlay(spark, sf_dir):
    """The trades serve rows and both legs and are kept, so that no task holds the sorts and hash maps of all three at once"""
    t = kept(fx.trades(spark, sf_dir).select("id", "open_time", "exit_time", "open_mark"))
    names = spark.range(8).select(F.col("id").alias("instrument_id"), F.when(F.col("id") < 3, "ESH4").otherwise("NQH4").alias("symbol"))
    return explore.overlay(t, _legs(t), names, "ES", "1996-01-01 00:00:00", "1998-01-01 00:00:00").select("id")


_RUN = f"""{fx.BARS}, lg AS (SELECT p.i AS position_id, p.i AS instrument_id, 1 AS sq, 50.0 AS e FROM (SELECT unnest(range(4)) AS i) p UNION ALL SELECT p.i, p.i + 4, -1, 40.0 FROM (SELECT unnest(range(4)) AS i) p),
rw AS (SELECT lg.*, ts_event, close FROM lg JOIN bars USING (instrument_id)), gr AS (SELECT t.position_id, t.ts_event, lg.instrument_id, sq, e, close FROM (SELECT DISTINCT position_id, ts_event FROM rw) t JOIN lg USING (position_id) LEFT JOIN bars ON bars.instrument_id = lg.instrument_id AND bars.ts_event = t.ts_event),
fl AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY position_id, instrument_id ORDER BY ts_event ROWS UNBOUNDED PRECEDING) AS c FROM gr), rp AS (SELECT position_id, ts_event, sum(sq * (e - c) * 50) AS pnl FROM fl GROUP BY 1, 2 HAVING count(c) = 2)"""


def _running(spark, sf_dir):
    i = F.col("id")
    legs = spark.range(4).select(i.alias("position_id"), i.alias("instrument_id"), F.lit(1).alias("signed_qty"), F.lit(50.0).alias("entry_price")).unionByName(spark.range(4).select(i.alias("position_id"), (i + 4).alias("instrument_id"), F.lit(-1).alias("signed_qty"), F.lit(40.0).alias("entry_price")))
    return explore.running_pnl(fx.bars(spark, sf_dir), legs, 50.0)


@R.add(f"WITH {_RUN} SELECT position_id, {T('ts_event')} AS ts_event, round(pnl, 2) AS pnl FROM rp")
def running_pnl(spark, sf_dir):
    """W17, K21"""
    return rounded(_running(spark, sf_dir), 2, "pnl").withColumn("ts_event", fx.text("ts_event"))


@R.add(f"""WITH {_RUN}, cd AS (SELECT DISTINCT p.i AS position_id, ts_event FROM bars CROSS JOIN (SELECT unnest(range(4)) AS i) p WHERE instrument_id = 2), j AS (SELECT cd.*, pnl FROM cd LEFT JOIN rp USING (position_id, ts_event))
SELECT position_id, {T('ts_event')} AS ts_event, round(last_value(pnl IGNORE NULLS) OVER (PARTITION BY position_id ORDER BY ts_event ROWS UNBOUNDED PRECEDING), 2) AS pnl FROM j""")
def padded_pnl(spark, sf_dir):
    """W18"""
    candles = fx.bars(spark, sf_dir).where("instrument_id = 2").select("ts_event").withColumn("position_id", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>")))
    return rounded(explore.padded_pnl(candles, _running(spark, sf_dir)), 2, "pnl").withColumn("ts_event", fx.text("ts_event"))


@R.add("SELECT c_custkey AS backtest_id, 'b' || c_custkey AS name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 0 AND 'b' || c_custkey LIKE '%1%'")
def tag_search(spark, sf_dir):
    """J29, P41"""
    k = F.col("c_custkey")
    c = fx.table(spark, sf_dir, "customer").select(k.alias("backtest_id"), F.concat(F.lit("b"), k.cast("string")).alias("name"))
    links = c.where("backtest_id % 3 = 0").select("backtest_id", F.lit(1).alias("tag_id")).unionByName(c.where("backtest_id % 2 = 0").select("backtest_id", F.lit(2).alias("tag_id")))
    tags = spark.createDataFrame([(1, "three"), (2, "even")], "tag_id int, name string")
    return explore.search(results.with_tags(c, links, tags), "1", ("three", "even")).select("backtest_id", "name")


@R.add("""SELECT s_suppkey AS backtest_id, -0.01 * (s_suppkey % 50) AS delta, CAST(s_suppkey % 30 AS INTEGER) AS dte, 0.5 AS take_profit_pct, CAST(NULL AS DOUBLE) AS min_credit FROM supplier""")
def strategy_summary(spark, sf_dir):
    """P37"""
    k = F.col("s_suppkey")
    text = F.format_string('{"trades":[{"legs":[{"name":"l","action":"buy_to_open","delta":{"target":-0.9},"dte":{"target":1}},{"name":"s","action":"sell_to_open","delta":{"target":%s},"dte":{"target":%d}}],"entry":{},"exit":{"take_profit_pct":0.5}}]}', (k % 50 * -0.01).cast("string"), k % 30)
    s = fx.table(spark, sf_dir, "supplier").select(k.alias("backtest_id"), text.alias("strategy_params"))
    return explore.strategy_summary(s).select("backtest_id", "delta", "dte", "take_profit_pct", "min_credit")


@R.add("SELECT CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00') ELSE strftime(o_orderdate, '%Y-%m-%d 00:00:00') END AS ts, o_totalprice AS pnl FROM orders WHERE o_orderkey % 7 <> 0")
def uploaded_trades(spark, sf_dir):
    """Bad rows are skipped, three date forms are read"""
    k = F.col("o_orderkey")
    form = lambda f: F.date_format(fx.ntz("o_orderdate"), f)
    date = F.when(k % 7 == 0, "soon").when(k % 3 == 0, form("yyyy-MM-dd")).when(k % 3 == 1, form("MM/dd/yyyy")).otherwise(form("yyyy-MM-dd HH:mm:ss"))
    raw = fx.table(spark, sf_dir, "orders").select(date.alias("DateTime"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("Realized_PnL"))
    return files.uploaded_trades(raw).withColumn("ts", fx.text("ts"))


@R.add("""WITH a AS (SELECT s_suppkey AS id, 0 AS part FROM supplier UNION ALL SELECT p_partkey, 1 FROM part) SELECT CASE WHEN part = 1 THEN id + (SELECT max(s_suppkey) FROM supplier) ELSE id END AS id, part, id AS old_id FROM a""")
def merged_results(spark, sf_dir):
    """S24, U1, U2, V7"""
    a = fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    b = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("x").alias("extra"))
    return results.merge([a, b]).select("id", "part", "old_id")


@R.add("""WITH r AS (SELECT o_custkey AS backtest_id, o_orderkey, o_orderdate, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders)
SELECT CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'failed' ELSE 'running' END AS status, count(*) AS n, CAST(sum(CASE WHEN backtest_id % 5 = 2 THEN 50000 ELSE 10000 END) AS DOUBLE) AS equity FROM r WHERE n = 1 AND backtest_id % 4 <> 1 GROUP BY 1""")
def run_metadata(spark, sf_dir):
    """S22, S23, S25, A16"""
    k = F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    rows = fx.table(spark, sf_dir, "orders").select(k.alias("backtest_id"), (k % 5).alias("study_id"), status.alias("status"), F.col("o_orderkey").alias("updated_at"), F.lit(10000.0).alias("initial_equity"))
    newest = results.without(results.latest(rows), rows.where("backtest_id % 4 = 1").select("backtest_id").distinct())
    return results.set_equity(newest, 50000, study_id=2).groupBy("status").agg(F.count("*").alias("n"), F.sum("initial_equity").alias("equity"))


@R.add("SELECT 'new' AS side, CAST(count(*) AS BIGINT) AS n FROM supplier WHERE s_suppkey % 9 = 0 UNION ALL SELECT 'old', count(*) FROM supplier WHERE s_suppkey % 9 = 0")
def compared_dumps(spark, sf_dir):
    """S26"""
    s = fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal") if "s_acctbal" in fx.table(spark, sf_dir, "supplier").columns else fx.table(spark, sf_dir, "supplier").select("s_suppkey").withColumn("s_acctbal", F.lit(1.0))
    changed = s.withColumn("s_acctbal", F.when(F.col("s_suppkey") % 9 == 0, F.coalesce("s_acctbal", F.lit(0.0)) + 1).otherwise(F.col("s_acctbal")))
    return files.compare_dumps(s, changed).groupBy("side").agg(F.count("*").alias("n"))


@R.add("""WITH b AS (SELECT c_custkey AS id, c_custkey % 7 AS s, CASE c_custkey % 3 WHEN 0 THEN 'failed' ELSE 'complete' END AS st, 'strategy ' || c_custkey % 2 AS n FROM customer), m AS (SELECT o_custkey AS id, count(*) AS n, round(max(o_totalprice), 2) AS sharpe FROM orders GROUP BY 1)
SELECT s AS study_id, count(*) AS n_backtests, count(*) FILTER (st = 'complete') AS n_complete, count(*) FILTER (st = 'failed') AS n_failed, max(sharpe) AS best_sharpe, CAST(sum(m.n) AS BIGINT) AS n_trades, string_agg(DISTINCT b.n, ',' ORDER BY b.n) AS strategies,
CASE WHEN bool_or(b.id % 2 = 0) THEN 'even' ELSE '' END AS tags FROM b LEFT JOIN m ON m.id = b.id GROUP BY 1""")
def study_overview(spark, sf_dir):
    """A16, A18, J29"""
    k = F.col("c_custkey")
    c = fx.table(spark, sf_dir, "customer").select(k.alias("backtest_id"), (k % 7).alias("study_id"), F.when(k % 3 == 0, "failed").otherwise("complete").alias("status"), F.concat(F.lit("strategy "), (k % 2).cast("string")).alias("strategy_name"))
    links = c.where("backtest_id % 2 = 0").select("backtest_id", F.lit(1).alias("tag_id"))
    tagged = results.with_tags(c, links, spark.createDataFrame([(1, "even")], "tag_id int, name string"))
    m = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("backtest_id")).agg(F.count("*").alias("n_trades"), F.round(F.max("o_totalprice"), 2).alias("sharpe"))
    out = results.study_overview(tagged, m)
    return out.withColumns({"strategies": F.array_join("strategies", ","), "tags": F.array_join("tags", ",")})


@R.add(f"""WITH {_TR}, a AS (SELECT count(*) AS n, round(sum(net_pnl), 4) AS total FROM trades), b AS (SELECT max(o_orderkey) AS top FROM orders) SELECT n, total, top FROM a, b""")
def dashboard_totals(spark, sf_dir):
    """Two one-row aggregates side by side"""
    a = fx.trades(spark, sf_dir).agg(F.count("*").alias("n"), F.round(F.sum("net_pnl"), 4).alias("total"))
    return a.join(F.broadcast(fx.table(spark, sf_dir, "orders").agg(F.max("o_orderkey").alias("top"))))


@R.add(f"WITH {_TR} SELECT backtest_id, count(*) AS n, round(sum(net_pnl), 4) AS total, CAST(CAST(max(exit_time) AS DATE) AS VARCHAR) AS last_date FROM trades GROUP BY 1")
def cached_dashboard(spark, sf_dir):
    """A dashboard's figures out of the result cache; the second look computes nothing"""
    cache = ResultCache(spark, f"{shared_folder(spark)}/results-{uuid.uuid4().hex}")
    tables = [fx.table(spark, sf_dir, "orders"), fx.table(spark, sf_dir, "lineitem")]

    def compute():
        return fx.trades(spark, sf_dir).groupBy("backtest_id").agg(F.count("*").alias("n"), F.round(F.sum("net_pnl"), 4).alias("total"), F.max(F.to_date("exit_time")).cast("string").alias("last_date"))

    def again():
        raise AssertionError("the figures are there already")

    cache.get("dashboard", tables, compute)
    return cache.get("dashboard", tables, again)


@R.add(f"""SELECT event_id, CASE WHEN value > 100 THEN NULL ELSE value END AS shown FROM events WHERE value IS NOT NULL""")
def nan_to_null(spark, sf_dir):
    """P39"""
    from ..functions.expr import nan_to_null as shown

    e = fx.table(spark, sf_dir, "events").where("value is not null")
    return e.select("event_id", shown(F.when(F.col("value") > 100, F.lit(float("nan"))).otherwise(F.col("value"))).alias("shown"))


_SWEEP = {"name": "sweep", "universe": {}, "trades": [{"name": "t", "instrument": {"root_symbol": "ES"}, "legs": [{"name": "s", "right": "P", "action": "sell_to_open", "delta": {"target": [-0.2, -0.3]}, "dte": 10}], "entry": {"window": {"start": "10:00", "end": "14:00"}, "min_credit": {"start": 0.5, "stop": 2.0, "step": 0.5}}, "exit": {"stop_loss": [1.0, 2.0, 4.0]}}]}


@R.add("""SELECT CAST(row_number() OVER (ORDER BY c, s, d DESC) AS BIGINT) AS combination_id, c AS min_credit, s AS stop_loss, d AS delta FROM (VALUES (0.5::DOUBLE), (1.0), (1.5), (2.0)) a(c) CROSS JOIN (VALUES (1.0::DOUBLE), (2.0), (4.0)) b(s) CROSS JOIN (VALUES (-0.2::DOUBLE), (-0.3)) e(d)""")
def sweep_combinations(spark, sf_dir):
    """V1-V5: the grid of a study, the last axis fastest"""
    rows = [(k, p["trades.0.entry.min_credit"], p["trades.0.exit.stop_loss"], p["trades.0.legs.0.delta.target"]) for k, p, _ in expand(_SWEEP)]
    return spark.createDataFrame(rows, "combination_id long, min_credit double, stop_loss double, delta double")

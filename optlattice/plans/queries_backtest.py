"""Queries on the three passes of a backtest: entries, exits, enforcement and profit."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import enforce, entry, exit, pnl
from ..operators.ranks import kept
from . import backtest, study
from . import fixtures as fx
from .queries_market import T, _SMA, _tall
from .registry import Registry
from .strategy import parse_strategy

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

_CONTRACTS = """listed AS (SELECT * FROM (VALUES (0, DATE '2024-01-12'), (1, DATE '2024-01-19'), (2, DATE '2024-01-26'), (3, DATE '2024-02-02')) v(underlying_id, expiry)),
days AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events),
schedule AS (SELECT date, coalesce(arg_min(underlying_id, expiry) FILTER (expiry >= date + 5), max(underlying_id)) AS underlying_id FROM days CROSS JOIN listed GROUP BY date)"""


def _schedule(spark, sf_dir):
    listed = spark.createDataFrame([(0, "2024-01-12"), (1, "2024-01-19"), (2, "2024-01-26"), (3, "2024-02-02")], "underlying_id long, expiry string").withColumn("expiry", F.to_date("expiry"))
    days = fx.table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"))
    return entry.roll_schedule(days, listed, 5)


@R.add(f"WITH {_CONTRACTS} SELECT CAST(date AS VARCHAR) AS date, CAST(s.underlying_id AS BIGINT) AS underlying_id, CAST(expiry AS VARCHAR) AS expiry, CAST(CASE WHEN s.underlying_id < 3 THEN s.underlying_id + 1 ELSE -1 END AS BIGINT) AS next_underlying_id FROM schedule s JOIN listed USING (underlying_id)")
def roll_schedule(spark, sf_dir):
    """K6, T5"""
    s = _schedule(spark, sf_dir)
    return s.select(F.col("date").cast("string").alias("date"), "underlying_id", F.col("expiry").cast("string").alias("expiry"), F.coalesce("next_underlying_id", F.lit(-1)).alias("next_underlying_id"))


@R.add(f"""WITH {fx.BARS}, {_CONTRACTS}, x AS (SELECT b.instrument_id, b.ts_event, b.close, s.underlying_id, l.expiry, CAST(ts_event AS DATE) AS date, timezone('America/New_York', timezone('UTC', ts_event)) AS t
FROM bars b JOIN schedule s ON s.date = CAST(b.ts_event AS DATE) AND s.underlying_id = b.instrument_id JOIN listed l ON l.underlying_id = s.underlying_id),
c AS (SELECT * FROM x WHERE hour(t) * 3600 + minute(t) * 60 BETWEEN 36000 AND 54000 AND isodow(t) < 6)
SELECT {T('ts_event')} AS ts_event, close, instrument_id AS search_id FROM c UNION ALL SELECT {T('ts_event')}, close, instrument_id + 1 FROM c WHERE expiry - date <= 7 AND instrument_id < 3""")
def entry_candidates(spark, sf_dir):
    """P9, P10, K7"""
    rows = entry.candidates(fx.bars(spark, sf_dir), _schedule(spark, sf_dir), ("10:00", "15:00"))
    return entry.contracts_to_search(rows, 7).select(fx.text("ts_event").alias("ts_event"), "close", "search_id")


#: Put spreads: a sold put near delta -0.3 and a bought one 25 points below, of both futures.
_LEGS = f"""{fx.CHAIN}, near AS (SELECT *, row_number() OVER (PARTITION BY ts_event ORDER BY abs(delta + 0.3), strike_price, instrument_id) AS n FROM chain
 WHERE right_ = 'P' AND delta BETWEEN -0.4 AND -0.2 AND dte BETWEEN 4 AND 16 AND hour(ts_event) BETWEEN 15 AND 19),
sold AS (SELECT * FROM near WHERE n = 1),
far AS (SELECT s.ts_event, c.instrument_id, c.strike_price, c.close, row_number() OVER (PARTITION BY s.ts_event ORDER BY abs(c.strike_price - (s.strike_price - 25)), c.strike_price) AS n
 FROM sold s JOIN chain c ON c.ts_event = s.ts_event AND c.underlying_id = s.underlying_id AND c.expiration = s.expiration AND c.right_ = 'P' AND abs(c.strike_price - (s.strike_price - 25)) <= 1),
ent AS (SELECT s.ts_event, s.underlying_id, s.expiration, s.instrument_id AS sold_id, s.strike_price AS sold_k, s.close AS sold_close, f.instrument_id AS bought_id, f.strike_price AS bought_k, f.close AS bought_close,
 round(round((s.close - f.close) / 0.05) * 0.05, 4) AS open_mark, round((s.close - f.close) / 0.05) * 0.05 AS mark, row_number() OVER (ORDER BY s.ts_event) - 1 AS entry_id FROM sold s JOIN far f ON f.ts_event = s.ts_event AND f.n = 1 WHERE round((s.close - f.close) / 0.05) * 0.05 >= 0.5)"""


def _entries(spark, sf_dir):
    options = fx.options(spark, sf_dir)
    times = fx.hours(spark, sf_dir).where(F.hour("ts_event").between(15, 19)).select("ts_event", F.col("underlying_id").alias("search_id"))
    wanted = [entry.Wanted("short", "P", F.lit(-0.3), F.lit(0.1), F.lit(10), F.lit(6)), entry.Wanted("long", "P", offset=-25.0, reference="short")]
    legs = entry.choose_legs(times, options, wanted)
    return entry.entries(legs, {"short": ("sell_to_open", 1), "long": ("buy_to_open", 1)}, tick=0.05, take_profit_pct=0.5, stop_loss=2.0, min_credit=0.5)


@R.add(f"WITH {_LEGS} SELECT entry_id, {T('ts_event')} AS entry_time, open_mark, round(round(mark * 0.5 / 0.05) * 0.05, 4) AS tp_price, round(round((mark + 2) / 0.05) * 0.05, 4) AS sl_price, sold_id, sold_k, bought_id, bought_k FROM ent")
def entries_by_delta_and_offset(spark, sf_dir):
    """J6, J31, T1, T2, P12, P19-P21, W12"""
    e = _entries(spark, sf_dir)
    leg = lambda name, f: F.filter("legs", lambda x: x["leg_name"] == name)[0][f]
    return e.select(F.col("entry_id").cast("long").alias("entry_id"), fx.text("entry_time").alias("entry_time"), F.round("open_mark", 4).alias("open_mark"), F.round("tp_price", 4).alias("tp_price"), F.round("sl_price", 4).alias("sl_price"), leg("short", "instrument_id").alias("sold_id"), leg("short", "strike_price").alias("sold_k"), leg("long", "instrument_id").alias("bought_id"), leg("long", "strike_price").alias("bought_k"))


#: Pairs of event instruments: sold i, bought i + 4, opened at noon of every day of the events for three days.
_PAIRS = f"""{fx.BARS}, days AS (SELECT CAST(ts AS DATE) AS day, row_number() OVER (ORDER BY CAST(ts AS DATE)) - 1 AS i FROM events WHERE ts IS NOT NULL GROUP BY 1),
ent AS (SELECT (d.i * 4 + p.i) AS entry_id, d.day + INTERVAL 12 HOUR AS entry_time, p.i AS a, p.i + 4 AS b, d.day + 3 AS expiration,
 CASE WHEN (d.i + p.i) % 2 = 0 THEN 20.0 ELSE -20.0 END AS open_mark FROM days d CROSS JOIN (SELECT unnest(range(4)) AS i) p),
lb AS (SELECT entry_id, entry_time, expiration, open_mark, l.sq, l.leg, bars.* FROM (SELECT *, 1 AS sq, a AS leg FROM ent UNION ALL SELECT *, -1, b FROM ent) l JOIN bars ON bars.instrument_id = l.leg AND bars.ts_event > entry_time
 AND CAST(timezone('America/New_York', timezone('UTC', bars.ts_event)) AS DATE) <= expiration),
times AS (SELECT DISTINCT entry_id, ts_event FROM lb),
grid AS (SELECT t.entry_id, t.ts_event, n.leg, n.sq, lb.open, lb.high, lb.low, lb.close, lb.volume FROM times t JOIN (SELECT DISTINCT entry_id, leg, sq FROM lb) n USING (entry_id) LEFT JOIN lb ON lb.entry_id = t.entry_id AND lb.ts_event = t.ts_event AND lb.leg = n.leg),
fill AS (SELECT *, last_value(close IGNORE NULLS) OVER w AS c, last_value(open IGNORE NULLS) OVER w AS o, last_value(CASE WHEN close IS NOT NULL THEN ts_event END IGNORE NULLS) OVER w AS seen FROM grid WINDOW w AS (PARTITION BY entry_id, leg ORDER BY ts_event ROWS UNBOUNDED PRECEDING)),
marks AS (SELECT entry_id, ts_event, round(sum(sq * c), 4) AS position_mark, round(sum(sq * o), 4) AS spread_open_mark, min(coalesce(volume, 0)) AS min_leg_volume, round(sum(coalesce((high - low) / 2, 0)), 4) AS total_slippage,
 max(date_diff('minute', seen, ts_event)) AS stale FROM fill GROUP BY 1, 2 HAVING count(c) = 2)"""


def _days(spark, sf_dir):
    """The days of the events, numbered: one row a day."""
    from pyspark.sql import Window

    days = fx.table(spark, sf_dir, "events").where("ts is not null").select(F.to_date(fx.ntz("ts")).alias("day")).distinct()
    return days.withColumn("d", (F.row_number().over(Window.orderBy("day")) - 1).cast("long"))


def _pairs(spark, sf_dir):
    rows = _days(spark, sf_dir).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<long>")))
    mark = F.when((F.col("d") + F.col("p")) % 2 == 0, 20.0).otherwise(-20.0)
    leg = lambda name, i, q: F.struct(F.lit(name).alias("leg_name"), i.alias("instrument_id"), F.lit(q).alias("signed_qty"), F.lit(0.0).alias("strike_price"), F.lit("C").alias("right"))
    return rows.select((F.col("d") * 4 + F.col("p")).alias("entry_id"), F.timestamp_add("HOUR", F.lit(12), F.col("day").cast("timestamp_ntz")).cast("timestamp_ntz").alias("entry_time"), F.date_add("day", 3).alias("trade_expiration"), mark.alias("open_mark"), (mark * 0.2).alias("tp_price"), (F.abs(mark) + 40).alias("sl_price"), F.array(leg("a", F.col("p"), 1), leg("b", F.col("p") + 4, -1)).alias("legs"), F.col("p").alias("underlying_id"))


@R.add(f"WITH {_PAIRS} SELECT entry_id, {T('ts_event')} AS ts_event, position_mark, spread_open_mark, min_leg_volume, total_slippage, stale AS max_leg_stale_minutes FROM marks")
def position_marks(spark, sf_dir):
    """J11, J12, A2, A3, W2, W3, W5, P28"""
    e = _pairs(spark, sf_dir)
    m = exit.marks(e, fx.bars(spark, sf_dir))
    return m.select("entry_id", fx.text("ts_event").alias("ts_event"), *(F.round(c, 4).alias(c) for c in ("position_mark", "spread_open_mark")), "min_leg_volume", F.round("total_slippage", 4).alias("total_slippage"), "max_leg_stale_minutes")


_FLAGS = f"""{_PAIRS}, m AS (SELECT k.*, open_mark, open_mark * 0.2 AS tp_price, abs(open_mark) + 40 AS sl_price, expiration, timezone('America/New_York', timezone('UTC', ts_event)) AS l,
 max(position_mark) OVER (PARTITION BY entry_id ORDER BY ts_event ROWS UNBOUNDED PRECEDING) AS worst, sum(min_leg_volume) OVER (PARTITION BY entry_id ORDER BY ts_event RANGE BETWEEN INTERVAL '89 MINUTE 59 SECOND 999999 MICROSECOND' PRECEDING AND CURRENT ROW) AS vol FROM marks k JOIN ent USING (entry_id)),
g AS (SELECT *, expiration - CAST(l AS DATE) AS dte_now, hour(l) * 3600 + minute(l) * 60 AS sec, (CASE WHEN open_mark > 0 THEN position_mark >= 0 ELSE position_mark <= 0 END) AND isodow(l) < 6 AND hour(l) * 3600 + minute(l) * 60 BETWEEN 34200 AND 57600 AND stale <= 240 AS ok FROM m),
f AS (SELECT *, spread_open_mark >= sl_price AND ok AS gap_sl, spread_open_mark <= tp_price AND ok AS gap_tp, position_mark >= sl_price AND ok AS sl, CAST(position_mark <= tp_price AND ok AS INTEGER) AS tp0 FROM g),
h AS (SELECT *, sum(tp0) OVER (PARTITION BY entry_id ORDER BY ts_event ROWS 1 PRECEDING) >= 2 AS tp FROM f),
p AS (SELECT *, CASE WHEN gap_sl THEN 1 WHEN gap_tp THEN 2 WHEN sl THEN 3 WHEN tp THEN 4 WHEN abs(position_mark) > 150 THEN 5 WHEN dte_now <= 1 AND sec BETWEEN 36000 AND 39600 THEN 6 WHEN dte_now <= 0 THEN 8 WHEN CAST(l AS DATE) >= expiration AND sec >= 57600 THEN 9 END AS priority FROM h)"""
_EXITS = f"""{_FLAGS}, first AS (SELECT entry_id, min({{'ts': ts_event, 'p': priority}}) AS k FROM p WHERE priority IS NOT NULL GROUP BY 1),
last AS (SELECT entry_id, arg_max(ts_event, {{'f': CAST(stale <= 240 AS INTEGER), 't': ts_event}}) AS ts FROM p GROUP BY 1),
pick AS (SELECT p.* FROM p JOIN last USING (entry_id) LEFT JOIN first USING (entry_id) WHERE p.ts_event = coalesce(first.k.ts, last.ts)),
exits AS (SELECT entry_id, ts_event AS exit_time, round(CASE WHEN coalesce(priority, 9) <= 2 THEN spread_open_mark WHEN open_mark > 0 AND position_mark < 0 THEN 0 WHEN open_mark < 0 AND position_mark > 0 THEN 0 ELSE position_mark END, 4) AS exit_mark, worst AS worst_mark,
 CASE coalesce(priority, 9) WHEN 1 THEN 'stop_loss' WHEN 2 THEN 'take_profit' WHEN 3 THEN 'stop_loss' WHEN 4 THEN 'take_profit' WHEN 5 THEN 'condition' WHEN 6 THEN 'roll' WHEN 8 THEN 'dte_exit' ELSE 'expiry' END AS exit_reason FROM pick)"""


def _exits(spark, sf_dir):
    e = _pairs(spark, sf_dir)
    rules = exit.ExitRules(conditions=("abs(position_mark) > 150",), confirmation_bars=2, max_leg_stale_minutes=240, roll_window=("10:00", "11:00"), roll_dte=1, dte_exit=0, expiry_close="16:00")
    return e, exit.first_exits(exit.flagged(exit.marks(e, fx.bars(spark, sf_dir)), e, rules), rules)


@R.add(f"WITH {_EXITS} SELECT entry_id, {T('exit_time')} AS exit_time, exit_mark, worst_mark, exit_reason FROM exits")
def first_exits(spark, sf_dir):
    """P13, P22-P33, W1, W7, T3, T4, W19"""
    _, x = _exits(spark, sf_dir)
    return x.select("entry_id", fx.text("exit_time").alias("exit_time"), F.round("exit_mark", 4).alias("exit_mark"), F.round("worst_mark", 4).alias("worst_mark"), "exit_reason")


#: A second set of rules: conditions on levels, volume over a while, a lock before expiry, slippage, vega triggers, settlement, a tick.
_SECOND = f"""{_PAIRS}, sc AS (SELECT instrument_id, CAST(l AS DATE) AS date, arg_max(close, ts_event) AS s FROM (SELECT *, timezone('America/New_York', timezone('UTC', ts_event)) AS l FROM bars) WHERE hour(l) * 60 + minute(l) <= 960 GROUP BY 1, 2),
st AS (SELECT ent.entry_id, round(greatest(0, s - 40) - greatest(0, s - 60), 4) AS settled FROM ent JOIN sc ON sc.instrument_id = ent.a AND sc.date = ent.expiration),
vg AS (SELECT entry_id, ts_event, sum(sq * volume) AS vega FROM lb GROUP BY 1, 2),
m AS (SELECT k.*, open_mark, open_mark * 0.2 AS tp, abs(open_mark) + 25 AS slp, expiration, settled, vega, timezone('America/New_York', timezone('UTC', k.ts_event)) AS l, max(position_mark) OVER (PARTITION BY k.entry_id ORDER BY k.ts_event ROWS UNBOUNDED PRECEDING) AS worst,
 sum(min_leg_volume) OVER (PARTITION BY k.entry_id ORDER BY k.ts_event RANGE BETWEEN INTERVAL '719 MINUTE 59 SECOND 999999 MICROSECOND' PRECEDING AND CURRENT ROW) AS vol FROM marks k JOIN ent USING (entry_id) LEFT JOIN st USING (entry_id) LEFT JOIN vg ON vg.entry_id = k.entry_id AND vg.ts_event = k.ts_event),
g AS (SELECT *, expiration - CAST(l AS DATE) AS dte_now, hour(l) * 3600 + minute(l) * 60 AS sec, (CASE WHEN open_mark > 0 THEN position_mark >= 0 ELSE position_mark <= 0 END) AND coalesce(vol >= 1, false) AS fair FROM m),
h AS (SELECT *, fair AND NOT (dte_now = 0 AND sec BETWEEN 57600 - 18000 AND 57600) AS ok FROM g),
f AS (SELECT *, coalesce(spread_open_mark + total_slippage >= slp AND ok AND max_stale < 900, false) AS gap_sl, coalesce(spread_open_mark + total_slippage <= tp AND ok AND dte_now >= 1, false) AS gap_tp, coalesce(position_mark + total_slippage >= slp AND ok AND max_stale < 900, false) AS sl, coalesce(position_mark + total_slippage <= tp AND ok AND dte_now >= 1, false) AS tp_hit FROM (SELECT *, stale AS max_stale FROM h) h),
p AS (SELECT *, CASE WHEN gap_sl THEN 1 WHEN gap_tp THEN 2 WHEN sl THEN 3 WHEN tp_hit THEN 4 WHEN (vega < -1 OR position_mark > 80) AND sec BETWEEN 32400 AND 43200 THEN 6 WHEN vega < -3 THEN 7 WHEN CAST(l AS DATE) >= expiration AND sec >= 57600 THEN 9 END AS priority FROM f),
first AS (SELECT entry_id, min({{'ts': ts_event, 'p': priority}}) AS k FROM p WHERE priority IS NOT NULL GROUP BY 1), last AS (SELECT entry_id, max(ts_event) AS ts FROM p GROUP BY 1),
pick AS (SELECT p.* FROM p JOIN last USING (entry_id) LEFT JOIN first USING (entry_id) WHERE p.ts_event = coalesce(first.k.ts, last.ts))
SELECT entry_id, {T('ts_event')} AS exit_time, round(round(CASE WHEN coalesce(priority, 9) <= 2 THEN spread_open_mark + total_slippage WHEN coalesce(priority, 9) = 9 AND settled IS NOT NULL THEN settled WHEN open_mark > 0 AND position_mark + total_slippage < 0 THEN 0 WHEN open_mark < 0 AND position_mark + total_slippage > 0 THEN 0 ELSE position_mark + total_slippage END / 0.0625) * 0.0625, 4) AS exit_mark,
round(round(worst / 0.0625) * 0.0625, 4) AS worst_mark, CASE coalesce(priority, 9) WHEN 1 THEN 'stop_loss' WHEN 2 THEN 'take_profit' WHEN 3 THEN 'stop_loss' WHEN 4 THEN 'take_profit' WHEN 6 THEN 'roll' WHEN 7 THEN 'vega_exit' ELSE 'expiry' END AS exit_reason FROM pick"""


@R.add(f"WITH {_SECOND}")
def first_exits_second_rules(spark, sf_dir):
    """P14, P25, P27, P30 by vega, P32 with slippage and settlement, a tick, after-hours exits on all days"""
    e, b = _pairs(spark, sf_dir), fx.bars(spark, sf_dir)
    e = e.withColumn("sl_price", F.abs("open_mark") + 25)
    rules = exit.ExitRules(after_hours=True, weekdays_only=False, stop_loss_condition="max_leg_stale_minutes < 900", take_profit_condition="dte_now >= 1", min_exit_volume=1, lookback_minutes=720, pre_expiry_lock_minutes=300, spread_slippage=True, expiry_close="16:00", roll_window=("09:00", "12:00"), roll_vega=-1.0, roll_conditions=("position_mark > 80",), vega_exit=-3.0, tick=0.0625)
    greek = b.select("instrument_id", "ts_event", F.col("volume").cast("double").alias("vega"))
    settled = exit.settlement_marks(e.withColumn("legs", F.transform("legs", lambda x: x.withField("strike_price", F.when(x["leg_name"] == "a", 40.0).otherwise(60.0)))), exit.settlement_closes(b))
    marked = exit.flagged(exit.marks(e, b), e, rules, None, exit.spread_vega(e, greek), settled.withColumn("settlement_mark", F.round("settlement_mark", 4)))
    x = exit.first_exits(marked, rules)
    return x.select("entry_id", fx.text("exit_time").alias("exit_time"), F.round("exit_mark", 4).alias("exit_mark"), F.round("worst_mark", 4).alias("worst_mark"), "exit_reason")


@R.add(f"WITH {_FLAGS} SELECT entry_id, {T('ts_event')} AS ts_event, CAST(sum(vol) AS BIGINT) AS volume FROM m WHERE vol IS NOT NULL GROUP BY 1, 2")
def rolling_volume(spark, sf_dir):
    """W6, P27"""
    m = exit.marks(_pairs(spark, sf_dir), fx.bars(spark, sf_dir))
    return m.select("entry_id", fx.text("ts_event").alias("ts_event"), exit.rolling_volume(90).alias("volume"))


@R.add(f"""WITH {_EXITS} SELECT entry_id, round((open_mark - exit_mark) * 50, 4) AS gross_pnl, round(abs(exit_mark) * 50 * 0.01, 4) AS slippage_cost, (0.65 + CASE WHEN exit_reason = 'expiry' THEN 0.25 ELSE 0.65 END) * 2 AS fee_cost,
round((open_mark - exit_mark) * 50 - abs(exit_mark) * 0.5 - (0.65 + CASE WHEN exit_reason = 'expiry' THEN 0.25 ELSE 0.65 END) * 2, 4) AS net_pnl FROM exits JOIN ent USING (entry_id)""")
def position_pnl(spark, sf_dir):
    """K16, J19"""
    e, x = _exits(spark, sf_dir)
    out = pnl.profit(e, x, 50.0, 0.01, 0.65, 0.65, 0.25)
    return out.select("entry_id", *(F.round(c, 4).alias(c) for c in ("gross_pnl", "slippage_cost", "fee_cost", "net_pnl")))


@R.add(f"""WITH {_EXITS}, l AS (SELECT entry_id, 0 AS leg_index, 'STO' AS action, a AS instrument_id FROM ent UNION ALL SELECT entry_id, 1, 'BTO', b FROM ent) SELECT row_number() OVER (ORDER BY entry_time, entry_id) AS id, entry_id, l0.instrument_id AS sold, l1.instrument_id AS bought
FROM exits JOIN ent USING (entry_id) JOIN l l0 USING (entry_id) JOIN l l1 USING (entry_id) WHERE l0.leg_index = 0 AND l1.leg_index = 1""")
def stored_legs(spark, sf_dir):
    """K17, S21"""
    e, x = _exits(spark, sf_dir)
    rows = e.join(x, "entry_id").withColumns({"close_": F.lit(0.0), "day": F.to_date("entry_time")})
    rows = rows.withColumn("legs", F.transform("legs", lambda v: v.withField("expiration", F.lit(None).cast("date")).withField("close", F.lit(0.0))))
    ids = pnl.with_ids(rows.select("entry_id", "entry_time", "day"), ["entry_time", "entry_id"], bucket="day")
    legs = pnl.leg_rows(rows)
    side = lambda action, name: legs.where(F.col("action") == action).select("entry_id", F.col("instrument_id").alias(name))
    return ids.select(F.col("id").cast("long").alias("id"), "entry_id").join(side("STO", "sold"), "entry_id").join(side("BTO", "bought"), "entry_id")


_HELD = """pos AS (SELECT event_id AS entry_id, user_id % 4 AS k, ts AS entry_time, ts + to_minutes(CAST(30 + event_id % 300 AS INTEGER)) AS gate_time, CASE WHEN event_id % 5 = 0 THEN 'stop_loss' WHEN event_id % 7 = 0 THEN 'roll' ELSE 'expiry' END AS exit_reason,
 CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'click')"""


def _held(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").where("event_type = 'click'").withColumn("ts", fx.ntz("ts"))
    gate = F.timestamp_add("MINUTE", (30 + F.col("event_id") % 300).cast("int"), "ts").cast("timestamp_ntz")
    reason = F.when(F.col("event_id") % 5 == 0, "stop_loss").when(F.col("event_id") % 7 == 0, "roll").otherwise("expiry")
    return e.select(F.col("event_id").alias("entry_id"), (F.col("user_id") % 4).alias("k"), F.col("ts").alias("entry_time"), gate.alias("gate_time"), gate.alias("exit_time"), reason.alias("exit_reason"), F.to_date("ts").alias("day"))


_WALK = """w(k, n, gate, day, c, free, kept, entry_id) AS (SELECT k, CAST(0 AS BIGINT), CAST(NULL AS TIMESTAMP), CAST(NULL AS DATE), 0, false, false, CAST(-1 AS BIGINT) FROM pos WHERE n = 1
UNION ALL SELECT p.k, p.n, CASE WHEN keep THEN p.gate_time ELSE gate END, CASE WHEN keep THEN p.day ELSE day_ END, CASE WHEN keep THEN CASE WHEN freed THEN c0 ELSE c0 + 1 END ELSE c_ END, CASE WHEN keep THEN p.exit_reason = 'roll' ELSE free_ END, keep, p.entry_id
FROM (SELECT p.*, w.gate AS gate, w.day AS day_, w.c AS c_, w.free AS free_, coalesce(w.day = p.day, false) AND w.free AS freed, CASE WHEN coalesce(w.day = p.day, false) THEN w.c ELSE 0 END AS c0,
 (w.gate IS NULL OR p.entry_time >= w.gate) AND ((CASE WHEN coalesce(w.day = p.day, false) THEN w.c ELSE 0 END) < {cap} OR (coalesce(w.day = p.day, false) AND w.free)) AS keep FROM w JOIN pos p ON p.k = w.k AND p.n = w.n + 1) p)"""


@R.add(f"WITH RECURSIVE {_HELD}, {_WALK.format(cap=2)} SELECT k, entry_id FROM w WHERE kept")
def greedy_walk(spark, sf_dir):
    """K9"""
    return enforce.greedy_walk(_held(spark, sf_dir), ["k"], max_per_day=2).select("k", "entry_id")


@R.add(f"WITH RECURSIVE {_HELD}, {_WALK.format(cap=2)} SELECT k, entry_id FROM w WHERE kept")
def greedy_walk_grouped(spark, sf_dir):
    """K9 for keys with very many entries"""
    return enforce.greedy_walk_grouped(_held(spark, sf_dir), ["k"], max_per_day=2).select("k", "entry_id")


@R.add(f"WITH RECURSIVE {_HELD}, {_WALK.format(cap=1000000)} SELECT k, entry_id FROM w WHERE kept")
def one_at_a_time(spark, sf_dir):
    """K10, J20"""
    return enforce.greedy_walk(_held(spark, sf_dir), ["k"]).select("k", "entry_id")


@R.add(f"WITH {_HELD}, x AS (SELECT *, min(CASE WHEN exit_reason = 'stop_loss' THEN gate_time END) OVER (PARTITION BY k, day) AS loss FROM pos) SELECT k, entry_id FROM x WHERE loss IS NULL OR entry_time <= loss")
def no_reentry_after_loss(spark, sf_dir):
    """K12"""
    return enforce.no_reentry_after_loss(_held(spark, sf_dir), ["k"]).select("k", "entry_id")


@R.add(f"""WITH {_HELD}, x AS (SELECT *, CASE WHEN lag(exit_reason) OVER d = 'roll' THEN 0 ELSE 1 END AS c FROM pos WINDOW d AS (PARTITION BY k, day ORDER BY entry_time, entry_id)), y AS (SELECT *, sum(c) OVER (PARTITION BY k, day ORDER BY entry_time, entry_id ROWS UNBOUNDED PRECEDING) AS s FROM x)
SELECT k, entry_id FROM y WHERE s <= 3""")
def daily_cap(spark, sf_dir):
    """K11, W13"""
    return enforce.daily_cap(_held(spark, sf_dir), ["k"], 3).select("k", "entry_id")


@R.add(f"""WITH {_HELD}, x AS (SELECT *, CASE WHEN exit_reason = 'stop_loss' THEN gate_time + INTERVAL 10 HOUR END AS e FROM pos), y AS (SELECT *, CAST(gate_time AS DATE) AS d FROM x)
SELECT entry_id, {T("CASE WHEN e IS NULL THEN gate_time ELSE greatest(e, d + CASE isodow(d) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END + INTERVAL '9 hours 30 minutes') END")} AS gate_time FROM y""")
def gate_times(spark, sf_dir):
    """K13, J21"""
    p = _held(spark, sf_dir).drop("gate_time")
    ends = p.where("exit_reason = 'stop_loss'").select("entry_id", F.timestamp_add("HOUR", F.lit(10), "exit_time").cast("timestamp_ntz").alias("exit_time"))
    return enforce.gate_times(p, ends).select("entry_id", fx.text("gate_time").alias("gate_time"))


#: Earlier names of the same queries.
for _name in ("greedy_walk", "greedy_walk_grouped", "one_at_a_time", "no_reentry_after_loss", "daily_cap", "gate_times"):
    R.add(ORACLE_SQL[_name], f"{_name}_whole")(QUERIES[_name])


#: Stopped positions: one of each instrument on every day of the events.
_STOPS = """days AS (SELECT CAST(ts AS DATE) AS day, row_number() OVER (ORDER BY CAST(ts AS DATE)) - 1 AS i FROM events WHERE ts IS NOT NULL GROUP BY 1),
st AS (SELECT d.i * 8 + p.i AS entry_id, p.i AS instrument_id, d.day + INTERVAL 15 HOUR AS exit_time, d.day + 2 AS expiration FROM days d CROSS JOIN (SELECT unnest(range(8)) AS i) p)"""


def _stops(spark, sf_dir):
    rows = _days(spark, sf_dir).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(7)).cast("array<long>")))
    return rows.select((F.col("d") * 8 + F.col("p")).alias("entry_id"), F.col("p").alias("instrument_id"), F.timestamp_add("HOUR", F.lit(15), F.col("day").cast("timestamp_ntz")).cast("timestamp_ntz").alias("exit_time"), F.date_add("day", 2).alias("expiration"))


@R.add(f"""WITH {fx.BARS}, {_STOPS}, r AS (SELECT st.*, b.ts_event, b.close, max(b.close) OVER (PARTITION BY entry_id ORDER BY b.ts_event ROWS UNBOUNDED PRECEDING) AS peak FROM st JOIN bars b ON b.instrument_id = st.instrument_id AND b.ts_event > st.exit_time AND CAST(timezone('America/New_York', timezone('UTC', b.ts_event)) AS DATE) <= expiration),
h AS (SELECT entry_id, min(ts_event) AS h FROM r WHERE peak > 0 AND close <= peak * 0.5 GROUP BY 1), e AS (SELECT entry_id, arg_min(close, ts_event) AS p0, max(ts_event) AS z FROM r GROUP BY 1)
SELECT e.entry_id, p0 AS entry_price, {T('r.ts_event')} AS exit_time, r.close AS exit_price, CASE WHEN h IS NULL THEN 'expiry' ELSE 'trailing_stop' END AS exit_reason, round((r.close - p0) * 50, 4) AS pnl FROM e LEFT JOIN h USING (entry_id) JOIN r ON r.entry_id = e.entry_id AND r.ts_event = coalesce(h, z)""")
def continuations(spark, sf_dir):
    """K14, K18, W14, J17"""
    found = exit.continuations(_stops(spark, sf_dir), fx.bars(spark, sf_dir))
    out = pnl.continuation_pnl(found, 50.0)
    return out.select("entry_id", "entry_price", fx.text("exit_time").alias("exit_time"), "exit_price", "exit_reason", F.round("pnl", 4).alias("pnl"))


@R.add(f"""WITH {fx.BARS}, {_STOPS}, l AS (SELECT entry_id, exit_time, instrument_id, 1 AS sq FROM st UNION ALL SELECT entry_id, exit_time, (instrument_id + 1) % 8, -1 FROM st),
f AS (SELECT entry_id, sq, arg_max(close, ts_event) FILTER (ts_event <= exit_time) AS b, arg_min(close, ts_event) FILTER (ts_event > exit_time) AS a FROM l JOIN bars USING (instrument_id) GROUP BY entry_id, sq)
SELECT entry_id, round(sum(sq * CASE WHEN sq > 0 THEN b ELSE coalesce(a, b) END), 4) AS exit_mark FROM f GROUP BY 1""")
def leg_out(spark, sf_dir):
    """J16, K15"""
    s = _stops(spark, sf_dir)
    legs = s.select("entry_id", "instrument_id", F.lit(1).alias("signed_qty")).unionByName(s.select("entry_id", ((F.col("instrument_id") + 1) % 8).alias("instrument_id"), F.lit(-1).alias("signed_qty")))
    return exit.leg_out_fills(s, legs, fx.bars(spark, sf_dir)).withColumn("exit_mark", F.round("exit_mark", 4))


@R.add(f"""WITH {_LEGS}, closes AS (SELECT underlying_id, CAST(l AS DATE) AS date, arg_max(spot, ts_event) AS s FROM (SELECT *, timezone('America/New_York', timezone('UTC', ts_event)) AS l FROM hours) WHERE hour(l) * 60 + minute(l) <= 960 GROUP BY 1, 2)
SELECT entry_id, round(greatest(0, sold_k - s) - greatest(0, bought_k - s), 4) AS settlement_mark FROM ent JOIN closes c ON c.underlying_id = ent.underlying_id AND c.date = ent.expiration""")
def settlement(spark, sf_dir):
    """A4, J18, P34"""
    closes = exit.settlement_closes(fx.underlying_bars(spark, sf_dir))
    out = exit.settlement_marks(_entries(spark, sf_dir), closes)
    return out.select(F.col("entry_id").cast("long").alias("entry_id"), F.round("settlement_mark", 4).alias("settlement_mark"))


_VEGA = f"""{_LEGS}, g AS MATERIALIZED (SELECT instrument_id, ts_event, spot * exp(-0.01 * t) * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(t) AS vega, close FROM chain WHERE t > 0 AND right_ = 'P'),
sv AS MATERIALIZED (SELECT entry_id, ent.ts_event AS entry_time, ent.expiration, ent.open_mark, s.ts_event, timezone('America/New_York', timezone('UTC', s.ts_event)) AS l, s.vega - b.vega AS vega, s.close - b.close AS mark FROM ent JOIN g s ON s.instrument_id = sold_id AND s.ts_event > ent.ts_event
 JOIN g b ON b.instrument_id = bought_id AND b.ts_event = s.ts_event WHERE CAST(timezone('America/New_York', timezone('UTC', s.ts_event)) AS DATE) <= ent.expiration)"""


@R.add(f"""WITH {_VEGA} SELECT entry_id, {T('ts_event')} AS ts_event, round(vega, 4) AS spread_vega, CAST(CAST(ts_event AS DATE) AS VARCHAR) AS day,
count(*) OVER d AS n, round(min(vega) OVER d, 4) AS low, round(max(vega) OVER d, 4) AS high, round(sum(vega) OVER d, 3) AS total FROM sv WINDOW d AS (PARTITION BY entry_id, CAST(ts_event AS DATE))""")
def spread_vega(spark, sf_dir):
    """Every bar from the entry to the expiration, with what its day comes to"""
    out = exit.spread_vega(_entries(spark, sf_dir), fx.option_greeks(spark, sf_dir).where("T > 0"))
    out = out.select(F.col("entry_id").cast("long").alias("entry_id"), "ts_event", "spread_vega", F.to_date("ts_event").cast("string").alias("day"))
    vega, day = F.col("spread_vega"), Window.partitionBy("entry_id", "day")
    of_day = {"n": F.count("*").over(day), "low": F.round(F.min(vega).over(day), 4), "high": F.round(F.max(vega).over(day), 4), "total": F.round(F.sum(vega).over(day), 3)}
    return out.select("entry_id", fx.text("ts_event").alias("ts_event"), F.round(vega, 4).alias("spread_vega"), "day", *(c.alias(name) for name, c in of_day.items()))


@R.add(f"""WITH {_VEGA}, o AS (SELECT *, first_value(vega) OVER (PARTITION BY entry_id ORDER BY ts_event) AS open_vega FROM sv),
p AS (SELECT *, CASE WHEN vega < 0.7 * open_vega THEN 5 WHEN vega > 1.1 * open_vega AND hour(l) * 60 + minute(l) BETWEEN 600 AND 720 THEN 6 WHEN CAST(l AS DATE) >= expiration THEN 9 END AS priority FROM o),
f AS (SELECT entry_id, min(ts_event) FILTER (priority IS NOT NULL) AS hit, max(ts_event) AS last FROM p GROUP BY 1)
SELECT entry_id, {T('p.ts_event')} AS exit_time, CASE priority WHEN 5 THEN 'condition' WHEN 6 THEN 'roll' ELSE 'expiry' END AS exit_reason, round(CASE WHEN mark < 0 THEN 0 ELSE mark END, 4) AS exit_mark FROM p JOIN f USING (entry_id) WHERE p.ts_event = coalesce(hit, last)""")
def vega_conditions(spark, sf_dir):
    """Positions that close or roll by their vega against that at their opening"""
    e = _entries(spark, sf_dir).withColumns({c: F.lit(None).cast("double") for c in ("tp_price", "sl_price")})
    rules = exit.ExitRules(conditions=("_spread_vega < 0.7 * open_vega",), roll_window=("10:00", "12:00"), roll_conditions=("_spread_vega > 1.1 * open_vega",))
    vega = exit.spread_vega(e, fx.option_greeks(spark, sf_dir).where("T > 0")) if rules.needs_vega() else None
    bars = fx.option_bars(spark, sf_dir).where("t > 0")
    x = exit.first_exits(exit.flagged(exit.marks(e, bars), e, rules, None, vega), rules)
    return x.select(F.col("entry_id").cast("long").alias("entry_id"), fx.text("exit_time").alias("exit_time"), "exit_reason", F.round("exit_mark", 4).alias("exit_mark"))


R.add(ORACLE_SQL["spread_vega"], "spread_vega_whole")(spread_vega)


@R.add(f"""WITH {_SMA}, {_CONTRACTS} SELECT name, count(*) AS n, round(sum(value), 4) AS total FROM tall JOIN schedule ON schedule.date = CAST(ts_event AS DATE) AND schedule.underlying_id = instrument_id GROUP BY 1""")
def stitched_indicators(spark, sf_dir):
    """J27"""
    from ..operators.explore import stitch

    rows = _tall(spark, sf_dir).withColumnRenamed("instrument_id", "underlying_id")
    return stitch(rows, _schedule(spark, sf_dir)).groupBy("name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@R.add(f"WITH {_LEGS} SELECT entry_id, round(sold_k - open_mark, 4) AS breakeven FROM ent")
def breakevens(spark, sf_dir):
    """K21"""
    from ..operators.explore import breakevens as found

    out = found(_entries(spark, sf_dir))
    return out.select(F.col("entry_id").cast("long").alias("entry_id"), F.round("breakeven", 4).alias("breakeven"))


@R.add(f"""WITH {_LEGS}, pos AS (SELECT *, round(open_mark, 2) AS mark, round(open_mark * 0.5, 2) AS left_, ts_event + INTERVAL 26 HOUR AS exit_time, CASE entry_id % 4 WHEN 0 THEN 'take_profit' WHEN 1 THEN 'stop_loss' WHEN 2 THEN 'expiry' ELSE 'roll' END AS reason, sold_close - bought_close AS credit FROM ent),
put AS MATERIALIZED (SELECT instrument_id, ts_event, close FROM chain WHERE t > 0 AND right_ = 'P'),
money AS MATERIALIZED (SELECT entry_id, pos.ts_event AS open_time, exit_time, a.ts_event AS tm, round((sold_close - a.close + b.close - bought_close) * 50, 2) AS pnl FROM pos JOIN put a ON a.instrument_id = sold_id AND a.ts_event > pos.ts_event AND a.ts_event < CAST(CAST(exit_time AS DATE) + 1 AS TIMESTAMP) JOIN put b ON b.instrument_id = bought_id AND b.ts_event = a.ts_event),
lst AS (SELECT entry_id, any_value(open_time) AS open_time, any_value(exit_time) AS exit_time, arg_max(pnl, tm) AS pnl FROM money WHERE tm <= exit_time GROUP BY 1),
later AS (SELECT money.* FROM money JOIN lst USING (entry_id) WHERE money.tm > money.exit_time),
shown AS (SELECT entry_id, 'pnl' AS series, open_time AS tm, 0.0::DOUBLE AS value, NULL AS label FROM lst UNION ALL SELECT entry_id, 'pnl', tm, pnl, NULL FROM money WHERE tm <= exit_time UNION ALL SELECT entry_id, 'after_exit', exit_time, pnl, NULL FROM lst WHERE entry_id IN (SELECT entry_id FROM later)
 UNION ALL SELECT entry_id, 'after_exit', tm, pnl, NULL FROM later UNION ALL SELECT entry_id, 'strike', NULL, sold_k, 'S P' || CAST(CAST(sold_k AS BIGINT) AS VARCHAR) FROM pos UNION ALL SELECT entry_id, 'strike', NULL, bought_k, 'L P' || CAST(CAST(bought_k AS BIGINT) AS VARCHAR) FROM pos
 UNION ALL SELECT entry_id, 'breakeven', NULL, round(sold_k - abs(credit), 2), 'P-BE' FROM pos UNION ALL SELECT entry_id, 'take_profit', NULL, round(credit * 0.4 * 50, 2), 'TP' FROM pos WHERE entry_id % 2 = 0 UNION ALL SELECT entry_id, 'stop_loss', NULL, -100.0, 'SL' FROM pos WHERE entry_id % 3 > 0
 UNION ALL SELECT entry_id, 'marker', ts_event, mark, 'Entry ' || printf('%.2f', mark) FROM pos
 UNION ALL SELECT entry_id, 'marker', exit_time, left_, CASE WHEN reason = 'expiry' THEN 'Exp ' || printf('%.2f', left_) ELSE 'Exit ' || printf('%.2f', left_) || ' - ' || CASE reason WHEN 'take_profit' THEN 'TP' WHEN 'stop_loss' THEN 'SL' ELSE reason END END FROM pos)
SELECT entry_id AS position_id, series, {T('tm')} AS shown_at, value + 0.0 AS value, label FROM shown""")
def trade_chart(spark, sf_dir):
    """Profit to the exit and after it, levels and markers of all positions, each held for 26 hours"""
    from ..operators.explore import trade_chart as chart

    e, k = kept(_entries(spark, sf_dir)), F.col("position_id")
    reason = F.element_at(F.array(*map(F.lit, ("take_profit", "stop_loss", "expiry", "roll"))), (k % 4 + 1).cast("int"))
    p = e.select(F.col("entry_id").cast("long").alias("position_id"), F.col("entry_time").alias("open_time"), F.timestamp_add("HOUR", F.lit(26), "entry_time").cast("timestamp_ntz").alias("exit_time"), F.round("open_mark", 2).alias("open_mark"), F.round(F.round("open_mark", 4) * 0.5, 2).alias("exit_mark"))
    p = p.withColumns({"exit_reason": reason, "take_profit_pct": F.when(k % 2 == 0, 0.4), "stop_loss": F.when(k % 3 > 0, 2.0)})
    legs = e.select(F.col("entry_id").cast("long").alias("position_id"), F.posexplode("legs").alias("leg_index", "l"))
    legs = legs.select("position_id", "leg_index", *(F.col(f"l.{c}").alias(c) for c in ("instrument_id", "signed_qty", "strike_price", "right", "multiplier")), F.col("l.close").alias("entry_price"))
    out = chart(p, legs, fx.option_bars(spark, sf_dir).where("t > 0"))
    return out.select("position_id", "series", fx.text("at").alias("shown_at"), (F.col("value") + 0.0).alias("value"), "label")


def _market(spark, sf_dir):
    """The market tables of a run. The indicator is the underlying's close of each hour against its contract's number."""
    bars = fx.underlying_bars(spark, sf_dir)
    trend = bars.select("ts_event", F.col("instrument_id").alias("underlying_id"), (F.col("close") - 4000).alias("trend"))
    return {"underlying_bars": bars, "option_bars": fx.option_bars(spark, sf_dir), "option_greeks": fx.option_greeks(spark, sf_dir).where("T > 0"), "indicators": trend}


def _definition(stop_loss=3.0, take_profit=None, max_entries=2):
    """A put spread of the front future between two dates, with an entry condition on a leg and an exit condition on an indicator."""
    return {
        "name": "put spread",
        "universe": {"start_date": "2024-01-03", "end_date": "2024-01-26", "session": {"start": "09:30", "end": "16:00"}, "audit_filter": "none"},
        "costs": {"slippage_pct": 0.01, "fees": {"entry": 0.65, "exit": 0.65, "expiration": 0.25}},
        "trades": [
            {
                "name": "put_spread",
                "instrument": {"root_symbol": "ES", "roll_days_before_expiry": 3},
                "legs": [
                    {"name": "short", "right": "put", "action": "sell_to_open", "delta": {"target": -0.3, "tolerance": 0.15}, "dte": 10, "dte_tolerance": 8},
                    {"name": "long", "right": "put", "action": "buy_to_open", "strike_offset": -25, "reference_leg": "short"},
                ],
                "entry": {"window": {"start": "10:00", "end": "14:00"}, "min_credit": 0.5, "max_entries_per_day": max_entries, "conditions": ["short.delta < -0.2", "trend > -11"]},
                "exit": {"stop_loss": stop_loss, "take_profit": take_profit or {"pct": 0.4, "confirmation_bars": 2}, "dte_exit": 0, "conditions": ["trend > 10", "trend < -12 and position_mark > 1"], "on_sl_long_continuation": True, "long_trailing_stop_pct": 0.4},
            }
        ],
    }


def _run_sql(combos: str) -> str:
    """The same backtest for all rows (combination_id, sl, tp_pct, tp_price) of `combos`; both legs have a bar in every hour of their underlying."""
    return f"""RECURSIVE {fx.CHAIN}, combos AS (SELECT * FROM (VALUES {combos}) v(combination_id, sl, tp_pct, tp_price)),
loc AS MATERIALIZED (SELECT *, spot - 4000 AS trend, timezone('America/New_York', timezone('UTC', ts_event)) AS l FROM hours),
u AS (SELECT * FROM loc WHERE CAST(l AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-26'),
sched AS (SELECT DISTINCT CAST(ts_event AS DATE) AS date, CASE WHEN DATE '2024-01-19' >= CAST(ts_event AS DATE) + 3 THEN 0 ELSE 1 END AS uid FROM u),
cand AS (SELECT u.ts_event, u.trend, uid FROM u JOIN sched ON sched.date = CAST(u.ts_event AS DATE) AND u.underlying_id = uid WHERE hour(l) * 60 + minute(l) BETWEEN 600 AND 840 AND isodow(l) < 6),
search AS (SELECT *, uid AS sid FROM cand UNION ALL SELECT *, 1 FROM cand WHERE uid = 0 AND DATE '2024-01-19' - CAST(ts_event AS DATE) <= 18),
near AS (SELECT c.*, s.trend, s.uid, row_number() OVER (PARTITION BY c.ts_event ORDER BY abs(delta + 0.3), strike_price, instrument_id) AS n FROM search s JOIN chain c ON c.ts_event = s.ts_event AND c.underlying_id = s.sid
 WHERE t > 0 AND right_ = 'P' AND delta BETWEEN -0.3 - 0.15 AND -0.3 + 0.15 AND dte BETWEEN 2 AND 18),
ent AS MATERIALIZED (SELECT s.ts_event AS entry_time, s.underlying_id, s.expiration, s.trend, s.delta, s.instrument_id AS sold_id, f.instrument_id AS bought_id, f.strike_price AS bought_k, s.close - f.close AS open_mark
 FROM near s JOIN chain f ON f.ts_event = s.ts_event AND f.underlying_id = s.underlying_id AND f.right_ = 'P' AND f.strike_price = s.strike_price - 25 WHERE s.n = 1 AND s.close - f.close >= 0.5),
e AS MATERIALIZED (SELECT c.*, ent.*, row_number() OVER (PARTITION BY combination_id ORDER BY entry_time) - 1 AS entry_id, CASE WHEN tp_pct IS NOT NULL THEN open_mark * (1 - tp_pct) ELSE open_mark - tp_price END AS tp, open_mark + sl AS stop FROM ent CROSS JOIN combos c WHERE delta < -0.2 AND trend > -11),
m AS MATERIALIZED (SELECT e.*, a.ts_event, a.close - b.close AS mark, h.l, h.trend AS now, max(a.close - b.close) OVER (PARTITION BY combination_id, entry_id ORDER BY a.ts_event ROWS UNBOUNDED PRECEDING) AS worst FROM e JOIN chain a ON a.instrument_id = sold_id AND a.ts_event > entry_time
 JOIN chain b ON b.instrument_id = bought_id AND b.ts_event = a.ts_event JOIN loc h ON h.ts_event = a.ts_event AND h.underlying_id = e.underlying_id WHERE CAST(h.l AS DATE) <= e.expiration),
f AS (SELECT *, mark >= 0 AND hour(l) * 60 + minute(l) BETWEEN 570 AND 960 AND isodow(l) < 6 AS ok FROM m),
g AS (SELECT *, mark >= stop AND ok AS gap_sl, mark <= tp AND ok AS gap_tp, CAST(mark <= tp AND ok AS INTEGER) AS hit FROM f),
p AS (SELECT *, CASE WHEN gap_sl THEN 1 WHEN gap_tp THEN 2 WHEN now > 10 OR (now < -12 AND mark > 1) THEN 5 WHEN CAST(l AS DATE) >= expiration THEN 8 END AS priority FROM g),
fst AS (SELECT combination_id, entry_id, min(ts_event) AS ts FROM p WHERE priority IS NOT NULL GROUP BY 1, 2), lst AS (SELECT combination_id, entry_id, max(ts_event) AS ts FROM p GROUP BY 1, 2),
x AS MATERIALIZED (SELECT p.*, CASE WHEN coalesce(priority, 9) = 1 THEN 'stop_loss' WHEN priority = 2 THEN 'take_profit' WHEN priority = 5 THEN 'condition' WHEN priority = 8 THEN 'dte_exit' ELSE 'expiry' END AS reason,
 CASE WHEN coalesce(priority, 9) <= 2 THEN mark WHEN mark < 0 THEN 0 ELSE mark END AS exit_mark FROM p JOIN lst USING (combination_id, entry_id) LEFT JOIN fst USING (combination_id, entry_id) WHERE p.ts_event = coalesce(fst.ts, lst.ts)),
cb AS (SELECT x.combination_id, x.entry_id, c.ts_event, c.close, max(c.close) OVER (PARTITION BY combination_id, entry_id ORDER BY c.ts_event ROWS UNBOUNDED PRECEDING) AS peak FROM x JOIN chain c ON c.instrument_id = bought_id AND c.ts_event > x.ts_event AND CAST(timezone('America/New_York', timezone('UTC', c.ts_event)) AS DATE) <= x.expiration WHERE reason = 'stop_loss'),
cs AS (SELECT combination_id, entry_id, min(ts_event) FILTER (peak > 0 AND close <= peak * (1 - 0.4)) AS h, max(ts_event) AS z, arg_min(close, ts_event) AS p0 FROM cb GROUP BY 1, 2),
closes AS (SELECT underlying_id, CAST(l AS DATE) AS date, arg_max(spot, ts_event) AS s FROM loc WHERE hour(l) * 60 + minute(l) <= 960 GROUP BY 1, 2),
cont AS MATERIALIZED (SELECT cs.combination_id, cs.entry_id, coalesce(h, z) AS cont_end, (CASE WHEN h IS NOT NULL THEN b.close WHEN s IS NOT NULL THEN greatest(0, bought_k - s) ELSE b.close END - p0) * 50 AS cont_pnl FROM cs JOIN x USING (combination_id, entry_id) JOIN cb b ON b.combination_id = cs.combination_id AND b.entry_id = cs.entry_id AND b.ts_event = coalesce(h, z) LEFT JOIN closes c ON c.underlying_id = x.underlying_id AND c.date = x.expiration),
o AS (SELECT x.*, cont_pnl, CASE WHEN cont_end IS NULL THEN x.ts_event ELSE greatest(cont_end, timezone('UTC', timezone('America/New_York', CAST(CAST(l AS DATE) + CASE isodow(l) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END + INTERVAL '9 hours 30 minutes' AS TIMESTAMP)))) END AS gate_time FROM x LEFT JOIN cont USING (combination_id, entry_id)),
pos AS MATERIALIZED (SELECT combination_id AS k, entry_id, entry_time, gate_time, reason AS exit_reason, CAST(timezone('America/New_York', timezone('UTC', entry_time)) AS DATE) AS day, row_number() OVER (PARTITION BY combination_id ORDER BY entry_time) AS n FROM o), {_WALK.format(cap=2)}
SELECT CAST(o.combination_id AS BIGINT) AS combination_id, {T('o.entry_time')} AS entry_time, {T('o.ts_event')} AS exit_time, o.reason AS exit_reason, round(open_mark, 6) AS open_mark, round(exit_mark, 6) AS exit_mark, round(worst, 6) AS worst_mark, round(cont_pnl, 4) AS continuation_pnl,
round((open_mark - exit_mark) * 50 - abs(exit_mark) * 0.5 - (0.65 + CASE WHEN o.reason = 'expiry' THEN 0.25 ELSE 0.65 END) * 2, 4) AS net_pnl FROM o JOIN w ON w.k = o.combination_id AND w.entry_id = o.entry_id WHERE w.kept"""


def _shown(rows):
    numbers = {c: F.round(c, 6) for c in ("open_mark", "exit_mark", "worst_mark")} | {c: F.round(c, 4) for c in ("continuation_pnl", "net_pnl")}
    return rows.withColumns({**numbers, **{c: fx.text(c) for c in ("entry_time", "exit_time")}}).select("combination_id", "entry_time", "exit_time", "exit_reason", "open_mark", "exit_mark", "worst_mark", "continuation_pnl", "net_pnl")


@R.add("WITH " + _run_sql("(1, 3.0::DOUBLE, 0.4::DOUBLE, NULL::DOUBLE)").replace(", CAST(mark <= tp AND ok AS INTEGER) AS hit FROM f", " FROM f"))
def whole_backtest(spark, sf_dir):
    """K8 and all it uses: dates, roll schedule, legs, conditions on legs and indicators, take-profit as an object, exits, continuation, gates, caps, costs"""
    return _shown(backtest.run(parse_strategy(_definition()), _market(spark, sf_dir)).withColumn("combination_id", F.lit(1).cast("long")))


@R.add("WITH " + _run_sql(", ".join(f"({1 + 2 * i + j}, {sl}::DOUBLE, {'NULL' if tp > 1 else tp}::DOUBLE, {tp if tp > 1 else 'NULL'}::DOUBLE)" for i, sl in enumerate((1.0, 2.0, 4.0)) for j, tp in enumerate((0.3, 1.5)))))
def study_grid(spark, sf_dir):
    """V6: a study of three stop losses and two take-profits, with a combination that fails left out"""
    definition = _definition([1.0, 2.0, 4.0], [{"pct": 0.3}, {"price": 1.5}])
    rows, failed = study.run_study([definition], _market(spark, sf_dir))
    if failed:
        raise ValueError(failed)
    return _shown(rows)


def _combos(rows):
    number = lambda x: "NULL" if x is None else x
    return ", ".join(f"({k}, {number(sl)}::DOUBLE, {number(pct)}::DOUBLE, NULL::DOUBLE)" for k, (sl, pct) in enumerate(rows, 1))


#: Stop losses and shares of profit of a study whose first strategy lists its combinations and whose second has a range.
_LISTED = [(1.5, 0.25), (3.0, None), (5.0, 0.35)]
_RANGE = [(1.0, 0.4), (1.5, 0.4), (2.0, 0.4)]


@R.add("WITH " + _run_sql(_combos(_LISTED + _RANGE)))
def study_of_tables_and_ranges(spark, sf_dir):
    """V1, V3-V6: listed combinations, of which one turns the profit target off, and a range, numbered through; all run over the market tables"""
    listed = _definition() | {"combinations": {"columns": ["trades.0.exit.stop_loss", "trades.0.exit.take_profit.pct"], "rows": [list(r) for r in _LISTED]}}
    rows, failed = study.run_study([listed, _definition({"start": 1.0, "stop": 2.0, "step": 0.5})], _market(spark, sf_dir))
    if failed:
        raise ValueError(failed)
    return _shown(rows)


_CONTINUED = ("WITH " + _run_sql(_combos(_RANGE))).replace("\nSELECT CAST(o.combination_id", ", fin AS (SELECT CAST(o.combination_id")


@R.add(f"""{_CONTINUED}), ids AS (SELECT row_number() OVER (ORDER BY combination_id, entry_time) AS position_id, * FROM fin)
SELECT row_number() OVER (ORDER BY position_id) + 70 AS id, position_id, combination_id AS backtest_id, entry_time AS open_time, continuation_pnl FROM ids WHERE continuation_pnl IS NOT NULL""")
def stored_continuations(spark, sf_dir):
    """A study's results as stored tables; continuations by the id of their position"""
    from ..sources.results import run_tables

    rows, failed = study.run_study([_definition({"start": 1.0, "stop": 2.0, "step": 0.5})], _market(spark, sf_dir))
    if failed:
        raise ValueError(failed)
    tables = run_tables(rows.withColumnRenamed("combination_id", "backtest_id"), {"position_continuation": 71})
    opened = tables["position"].select(F.col("id").alias("position_id"), fx.text("open_time").alias("open_time"))
    found = tables["position_continuation"].join(opened, "position_id")
    return found.select("id", "position_id", "backtest_id", "open_time", F.round("continuation_pnl", 4).alias("continuation_pnl"))

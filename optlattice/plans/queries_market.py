"""Queries on bars, ingest, as-of joins, prices and audits. IDs name the rows of the operator inventory."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import clock, pricing
from ..functions.conditions import compile_condition, steps, targets
from ..functions.expr import clip_to_bound, contract_root, intrinsic, no_arbitrage, stop_loss_price, sum_horizontal, take_profit_price, tick_round, title_case
from ..operators import asof, audit, explore, greeks, indicators, ingest
from ..sources import scans
from . import fixtures as fx
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql
T = "strftime({}, '%Y-%m-%d %H:%M:%S')".format
NY = "timezone('America/New_York', timezone('UTC', {}))".format


def _resampled(size: str, start: str):
    """A30 with one bucket size; start is the bucket's SQL over the local time `l`."""
    sql = f"""WITH {fx.BARS}, x AS (SELECT *, {NY('ts_event')} AS l FROM bars)
SELECT instrument_id, {T(start)} AS bucket, arg_min(open, ts_event) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts_event) AS close, CAST(sum(volume) AS BIGINT) AS volume
FROM x GROUP BY instrument_id, {start}"""

    @R.add(sql, f"resample_{size}")
    def query(spark, sf_dir):
        return explore.resample(fx.bars(spark, sf_dir), size).withColumn("bucket", fx.text("bucket"))


for _size, _start in (("15m", "time_bucket(INTERVAL 15 MINUTE, l)"), ("1h", "date_trunc('hour', l)"), ("4h", "time_bucket(INTERVAL 4 HOUR, l)"), ("1d", "CAST(date_trunc('day', l) AS TIMESTAMP)"), ("1w", "CAST(date_trunc('week', l) AS TIMESTAMP)"), ("1M", "CAST(date_trunc('month', l) AS TIMESTAMP)")):
    _resampled(_size, _start)


@R.add(f"""WITH v AS (SELECT user_id % 8 AS indicator_id, ts AS ts_event, CASE WHEN event_type = 'click' THEN value END AS value FROM events), x AS (SELECT *, date_trunc('hour', {NY('ts_event')}) AS b FROM v WHERE value IS NOT NULL)
SELECT indicator_id, {T('b')} AS bucket, arg_max(value, ts_event) AS value FROM x GROUP BY indicator_id, b""")
def resample_indicator(spark, sf_dir):
    """A31"""
    v = fx.table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("indicator_id"), fx.ntz("ts").alias("ts_event"), F.when(F.col("event_type") == "click", F.col("value")).alias("value"))
    return explore.resample_indicator(v, "1h").withColumn("bucket", fx.text("bucket"))


@R.add(f"""WITH {fx.BARS}, s AS (SELECT *, CASE WHEN instrument_id < 4 THEN 'ES' ELSE 'NQ' END || substr('HMUZHMUZ', CAST(instrument_id + 1 AS INTEGER), 1) || '4' AS symbol FROM bars),
one AS (SELECT 'contract' AS level, instrument_id, symbol, substr(symbol, 1, 2) AS root, min(ts_event) AS a, max(ts_event) AS b, count(*) AS n_bars FROM s GROUP BY instrument_id, symbol)
SELECT level, instrument_id, symbol, root, {T('a')} AS first_ts, {T('b')} AS last_ts, n_bars FROM one
UNION ALL SELECT 'root', -1, NULL, root, {T('min(a)')}, {T('max(b)')}, CAST(sum(n_bars) AS BIGINT) FROM one GROUP BY root""")
def contract_listing(spark, sf_dir):
    """A19, P36"""
    month = F.substring(F.lit("HMUZHMUZ"), (F.col("instrument_id") + 1).cast("int"), F.lit(1))
    b = fx.bars(spark, sf_dir).withColumn("symbol", F.concat(F.when(F.col("instrument_id") < 4, "ES").otherwise("NQ"), month, F.lit("4")))
    out = explore.contracts(b)
    return out.select("level", F.coalesce("instrument_id", F.lit(-1)).alias("instrument_id"), "symbol", "root", fx.text("first_ts").alias("first_ts"), fx.text("last_ts").alias("last_ts"), "n_bars")


_SIDES = """l AS (SELECT event_id, user_id % 20 AS k, ts AS ts_event, value FROM events WHERE event_type = 'purchase'),
r AS (SELECT user_id % 20 AS k, ts AS ts_event, max(value) AS spot FROM events WHERE event_type = 'view' GROUP BY 1, 2)"""


def _sides(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").withColumn("ts_event", fx.ntz("ts")).withColumn("k", F.col("user_id") % 20)
    left = e.where("event_type = 'purchase'").select("event_id", "k", "ts_event", "value")
    return left, e.where("event_type = 'view'").groupBy("k", "ts_event").agg(F.max("value").alias("spot"))


@R.add(f"""WITH {_SIDES} SELECT event_id, l.k, spot, CAST(floor(epoch(l.ts_event) - epoch(r.ts_event)) AS INTEGER) AS lag_s FROM l ASOF JOIN r ON l.k = r.k AND l.ts_event >= r.ts_event
WHERE epoch_us(l.ts_event) - epoch_us(r.ts_event) <= 7200000000""")
def asof_backward(spark, sf_dir):
    """J1"""
    left, right = _sides(spark, sf_dir)
    return asof.backward_bounded(left, right, ["k"], ["spot"], 7200).select("event_id", "k", "spot", "lag_s")


@R.add(f"""WITH {_SIDES}, u AS (SELECT event_id, k, ts_event, 1 AS side, CAST(NULL AS DOUBLE) AS spot FROM l UNION ALL SELECT NULL, k, ts_event, 0, spot FROM r),
w AS (SELECT *, last_value(spot IGNORE NULLS) OVER (PARTITION BY k, CAST(ts_event AS DATE) ORDER BY ts_event, side ROWS UNBOUNDED PRECEDING) AS f FROM u)
SELECT event_id, k, f AS spot FROM w WHERE side = 1""")
def asof_session_fill(spark, sf_dir):
    """J2, W4"""
    left, right = _sides(spark, sf_dir)
    return asof.session_fill(left.select("event_id", "k", "ts_event"), right, F.to_date("ts_event"), ["spot"], ["k"]).select("event_id", "k", "spot")


@R.add(f"""WITH {_SIDES}, p AS (SELECT event_id, l.k, spot, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(l.ts_event) - epoch_us(r.ts_event)), r.ts_event) AS n
FROM l JOIN r ON l.k = r.k AND abs(epoch_us(l.ts_event) - epoch_us(r.ts_event)) <= 3600000000) SELECT event_id, k, spot FROM p WHERE n = 1""")
def asof_nearest(spark, sf_dir):
    """J3"""
    left, right = _sides(spark, sf_dir)
    return asof.nearest(left, right, ["k"], ["spot"], 3600).select("event_id", "k", "spot")


@R.add("""SELECT event_id FROM events WHERE value > 20 AND NOT event_type = 'error' AND (abs(value - 50) / 2 <= 30 OR user_id * 2 + 1 != 31) AND (NOT event_type = 'view' OR value >= 40) AND value - 5 > -3""")
def conditions(spark, sf_dir):
    """P1-P7, P11"""
    e = fx.table(spark, sf_dir, "events")
    texts = ["value > 20 and not event_type == 'error'", "abs(value - 50) / 2 <= 30 or user_id * 2 + 1 != 31", "if event_type == 'view' then value >= 40", "value - 5 > -3"]
    for t in texts:
        e = e.where(compile_condition(t))
    return e.select("event_id")


@R.add("""SELECT event_id, CASE WHEN value < 20 THEN 0.1 WHEN value < 60 THEN 0.2 ELSE 0.3 END AS delta, CASE WHEN value < 20 THEN 0.05 WHEN value < 60 THEN NULL ELSE 0.1 END AS tolerance,
CASE WHEN value > 80 THEN 'far' WHEN event_type = 'click' THEN 'near' ELSE 'default' END AS target, CAST(CASE WHEN value > 80 THEN 45 WHEN event_type = 'click' THEN 7 ELSE 14 END AS DOUBLE) AS dte FROM events WHERE value IS NOT NULL""")
def stepped_targets(spark, sf_dir):
    """P15-P18"""
    e = fx.table(spark, sf_dir, "events").where("value is not null")
    s = steps(F.col("value"), [{"below": 20, "delta": 0.1, "tolerance": 0.05}, {"below": 60, "delta": 0.2}, {"delta": 0.3, "tolerance": 0.1}], ("delta", "tolerance"))
    t = targets({"near": {"priority": 2, "condition": "event_type == 'click'", "dte": 7}, "far": {"priority": 1, "condition": "value > 80", "dte": 45}, "default": {"dte": 14}}, ("dte",))
    return e.select("event_id", s["delta"].alias("delta"), s["tolerance"].alias("tolerance"), t["name"].alias("target"), t["dte"].alias("dte"))


@R.add("""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS n, round(l_extendedprice / 1000 - 40, 5) AS m, round(l_discount * 100 - 5, 0) AS o, l_quantity AS s FROM lineitem)
SELECT k, n, round(round(m / 0.25) * 0.25, 4) AS ticked, CASE WHEN o > 0 THEN m >= 0 WHEN o < 0 THEN m <= 0 ELSE true END AS fair, CASE WHEN o > 0 AND m < 0 THEN 0 WHEN o < 0 AND m > 0 THEN 0 ELSE m END AS clipped,
round(m * 0.5, 7) AS tp_pct, round(m - 1.5, 5) AS tp_price, round(m + 2, 5) AS sl, greatest(0, s - 25) AS call_value, greatest(0, 25 - s) AS put_value, round(coalesce(NULLIF(m, 0), 0) + s, 5) AS total FROM x""")
def marks_and_levels(spark, sf_dir):
    """P19-P23, P34, horizontal sums"""
    li = fx.table(spark, sf_dir, "lineitem")
    x = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.round(F.col("l_extendedprice") / 1000 - 40, 5).alias("m"), F.round(F.col("l_discount") * 100 - 5, 0).alias("o"), F.col("l_quantity").alias("s"))
    m, o, s = F.col("m"), F.col("o"), F.col("s")
    return x.select("k", "n", F.round(tick_round(m, 0.25), 4).alias("ticked"), no_arbitrage(o, m).alias("fair"), clip_to_bound(o, m).alias("clipped"), F.round(take_profit_price(m, pct=0.5), 7).alias("tp_pct"), F.round(take_profit_price(m, price=1.5), 5).alias("tp_price"), F.round(stop_loss_price(m, 2.0), 5).alias("sl"), intrinsic(F.lit("C"), s, F.lit(25.0)).alias("call_value"), intrinsic(F.lit("P"), s, F.lit(25.0)).alias("put_value"), F.round(sum_horizontal(F.nullif(m, F.lit(0.0)), s), 5).alias("total"))


@R.add(f"""WITH x AS (SELECT event_id, {NY('ts')} AS l FROM events) SELECT event_id, strftime(l, '%Y-%m-%d %H:%M') AS local_minute FROM x WHERE hour(l) * 3600 + minute(l) * 60 BETWEEN 34200 AND 57600 AND isodow(l) < 6 AND CAST(l AS DATE) <> DATE '2024-01-15'""")
def entry_window(spark, sf_dir):
    """P8, P24, local clock"""
    e = fx.table(spark, sf_dir, "events").withColumn("l", clock.local(fx.ntz("ts")))
    keep = clock.in_window(F.col("l"), "09:30", "16:00") & clock.is_weekday(F.col("l")) & (F.to_date("l") != F.lit("2024-01-15").cast("date"))
    return e.where(keep).select("event_id", F.date_format("l", "yyyy-MM-dd HH:mm").alias("local_minute"))


_SEGMENTS = """segs AS (SELECT s_suppkey % 8 AS instrument_id, s_suppkey AS seg_id, DATE '2024-01-01' + CAST(s_suppkey % 20 AS INTEGER) AS seg_activation, DATE '2024-01-01' + CAST(s_suppkey % 20 + 3 + s_suppkey % 5 AS INTEGER) AS seg_expiration FROM supplier)"""


def _segments(spark, sf_dir):
    k = F.col("s_suppkey")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (k % 20).cast("int"))
    return fx.table(spark, sf_dir, "supplier").select((k % 8).alias("instrument_id"), k.alias("seg_id"), start.alias("seg_activation"), F.date_add(start, (3 + k % 5).cast("int")).alias("seg_expiration"))


@R.add(f"""WITH {fx.BARS}, {_SEGMENTS}, j AS (SELECT b.instrument_id, b.ts_event, seg_id, greatest(0, seg_activation - CAST(ts_event AS DATE), CAST(ts_event AS DATE) - seg_expiration) AS d, seg_expiration - seg_activation AS w, seg_activation AS a, seg_expiration AS z
FROM bars b JOIN segs USING (instrument_id)), q AS (SELECT *, row_number() OVER (PARTITION BY instrument_id, ts_event ORDER BY d, w, a, z, seg_id) AS n FROM j)
SELECT instrument_id, count(*) AS n_bars, CAST(sum(d) AS BIGINT) AS off_days, count(DISTINCT a) AS n_starts FROM q WHERE n = 1 GROUP BY 1""")
def route_recycled_ids(spark, sf_dir):
    """J7"""
    b = fx.bars(spark, sf_dir).withColumn("date", F.to_date("ts_event"))
    out = ingest.route(b, _segments(spark, sf_dir))
    return out.groupBy("instrument_id").agg(F.count("*").alias("n_bars"), F.sum("seg_distance").alias("off_days"), F.countDistinct("seg_activation").alias("n_starts"))


@R.add(f"""WITH {fx.BARS}, {_SEGMENTS}, j AS (SELECT instrument_id, ts_event FROM bars JOIN segs USING (instrument_id) WHERE CAST(ts_event AS DATE) BETWEEN seg_activation AND seg_expiration GROUP BY 1, 2 HAVING count(*) > 1)
SELECT instrument_id, count(*) AS bars FROM j GROUP BY 1""")
def segment_overlaps(spark, sf_dir):
    """A5"""
    return ingest.overlaps(fx.bars(spark, sf_dir).withColumn("date", F.to_date("ts_event")), _segments(spark, sf_dir))


#: Earlier names of the same queries.
for _name in ("route_recycled_ids", "segment_overlaps"):
    R.add(ORACLE_SQL[_name], f"{_name}_whole")(QUERIES[_name])


@R.add("""WITH x AS (SELECT CAST(p_partkey % 50 AS BIGINT) AS instrument_id, CASE p_partkey % 4 WHEN 0 THEN 'F' WHEN 1 THEN 'C' WHEN 2 THEN 'P' ELSE 'X' END AS c, p_partkey FROM part),
d AS (SELECT instrument_id, CASE WHEN p_partkey % 3 > 0 THEN DATE '2024-01-01' + CAST(p_partkey % 30 AS INTEGER) END AS activation FROM x WHERE c <> 'X' GROUP BY ALL)
SELECT instrument_id, count(*) AS n, CAST(min(activation) AS VARCHAR) AS first_activation FROM d GROUP BY 1""")
def decoded_definitions(spark, sf_dir):
    """S3, S4"""
    k = F.col("p_partkey")
    day = (19723 + k % 30) * F.lit(86_400_000_000_000)
    raw = fx.table(spark, sf_dir, "part").select(
        (k % 50).alias("instrument_id"),
        F.element_at(F.array(F.lit("F"), F.lit("C"), F.lit("P"), F.lit("X")), (k % 4 + 1).cast("int")).alias("instrument_class"),
        F.lit("ESH4").alias("symbol"),
        F.lit(1).alias("underlying_id"),
        F.lit(4_000_000_000_000).alias("strike_price"),
        F.lit(50_000_000_000).alias("unit_of_measure_qty"),
        F.when(k % 3 > 0, day).otherwise(F.lit(0)).alias("activation"),
        F.lit(9223372036854775807).alias("expiration"),
    )
    return ingest.decode_definitions(raw).groupBy("instrument_id").agg(F.count("*").alias("n"), F.min("activation").cast("string").alias("first_activation"))


@R.add(f"""WITH {fx.BARS}, f AS (SELECT instrument_id, ts_event, close FROM bars WHERE volume >= 1), s AS (SELECT * FROM f WHERE instrument_id % 2 = 0 AND ts_event < TIMESTAMP '2024-01-20')
SELECT f.instrument_id, {T('f.ts_event')} AS ts_event, f.close FROM f LEFT JOIN s USING (instrument_id, ts_event) WHERE s.close IS NULL""")
def idempotent_append(spark, sf_dir):
    """S7, S9, U4"""
    b = fx.bars(spark, sf_dir).select("instrument_id", "ts_event", "close")
    stored = b.where("instrument_id % 2 = 0 and ts_event < timestamp_ntz'2024-01-20 00:00:00'")
    twice = ingest.dedupe(b.withColumn("file_seq", F.lit(0)).unionByName(b.withColumn("file_seq", F.lit(1))), ["file_seq"]).drop("file_seq")
    return ingest.new_rows(twice, stored).withColumn("ts_event", fx.text("ts_event"))


@R.add("SELECT DISTINCT user_id % 200 AS instrument_id FROM events WHERE user_id % 200 NOT IN (SELECT s_suppkey FROM supplier)")
def missing_definitions(spark, sf_dir):
    """S2, S6"""
    b = fx.table(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("instrument_id"))
    return ingest.missing_definitions(b, fx.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("instrument_id")))


@R.add(f"""WITH {fx.CHAIN} SELECT instrument_id, {T('ts_event')} AS ts_event, round(close, 6) + 0.0 AS price, round(delta, 6) + 0.0 AS delta, round(exp(-0.01 * t) * exp(-d1 * d1 / 2) / sqrt(2 * pi()) / (spot * 0.2 * sqrt(t)), 8) AS gamma,
round(spot * exp(-0.01 * t) * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * sqrt(t), 4) AS vega, round((-spot * exp(-0.01 * t) * exp(-d1 * d1 / 2) / sqrt(2 * pi()) * 0.2 / (2 * sqrt(t)) + 0.01 * close) / 365, 5) + 0.0 AS theta, dte FROM chain WHERE t > 0""")
def black76_greeks(spark, sf_dir):
    """K1, K3, K4"""
    g, b = fx.option_greeks(spark, sf_dir), fx.option_bars(spark, sf_dir)
    rows = g.join(b.select("instrument_id", "ts_event", "close"), ["instrument_id", "ts_event"]).where("T > 0")
    return rows.select("instrument_id", fx.text("ts_event").alias("ts_event"), (F.round("close", 6) + 0.0).alias("price"), (F.round("delta", 6) + 0.0).alias("delta"), F.round("gamma", 8).alias("gamma"), F.round("vega", 4).alias("vega"), (F.round("theta", 5) + 0.0).alias("theta"), F.col("dte").cast("long").alias("dte"))


@R.add(f"""WITH {fx.CHAIN} SELECT instrument_id, {T('ts_event')} AS ts_event, CASE WHEN t > 0.004 AND close > 2 THEN 0.2 END AS iv, CAST(CASE WHEN t = 0 THEN 0 WHEN close > 0.00001 THEN 1 END AS DOUBLE) AS found, 0 AS underlying_lag_s FROM chain""")
def implied_volatility(spark, sf_dir):
    """What the bisection finds is the volatility that made the prices, and NaN for expired options

    All options are solved and all rows returned. iv is shown where the price tells it to three digits, found unless the
    price is within rounding errors of 0.
    """
    b = fx.option_bars(spark, sf_dir).drop("spot")
    g = greeks.compute(b, fx.underlying_bars(spark, sf_dir)).join(b.select("instrument_id", "ts_event", "close"), ["instrument_id", "ts_event"])
    iv = F.when((F.col("T") > 0.004) & (F.col("close") > 2), F.round("iv", 3))
    found = F.when((F.col("T") == 0) | (F.col("close") > 0.00001), (~F.isnan("iv")).cast("double"))
    return g.select("instrument_id", fx.text("ts_event").alias("ts_event"), iv.alias("iv"), found.alias("found"), "underlying_lag_s")


_BAD = f"""{fx.CHAIN}, ob AS MATERIALIZED (SELECT instrument_id, underlying_id, ts_event, expiration, strike_price, right_, spot, t, CASE WHEN instrument_id % 14 = 3 THEN -close ELSE close END AS close FROM chain WHERE (instrument_id + hour(ts_event)) % 3 > 0),
og AS MATERIALIZED (SELECT instrument_id, ts_event, CASE WHEN instrument_id % 14 = 5 THEN dte - 40 ELSE dte END AS dte, CASE instrument_id % 14 WHEN 1 THEN CAST('NaN' AS DOUBLE) WHEN 2 THEN 10.0 WHEN 4 THEN 3.0 ELSE 0.2 END AS iv,
 CASE WHEN instrument_id % 14 = 6 THEN -delta WHEN instrument_id % 14 = 7 THEN 1.5 ELSE delta END AS delta, t, spot, d1, strike_price, right_ FROM chain WHERE delta IS NOT NULL),
e1 AS MATERIALIZED (SELECT instrument_id, ts_event, delta, t, right_, (ln(spot / strike_price) + iv * iv / 2 * t) / (iv * sqrt(t)) AS x FROM og WHERE NOT isnan(iv)),
gaps AS MATERIALIZED (SELECT instrument_id, ts_event, abs(delta - exp(-0.01 * t) * CASE WHEN right_ = 'C' THEN {fx._cdf_sql("x")} ELSE {fx._cdf_sql("x")} - 1 END) AS gap FROM e1 JOIN ob USING (instrument_id, ts_event, t, right_))"""


def _bad(spark, sf_dir):
    i = F.col("instrument_id") % 14
    b = fx.option_bars(spark, sf_dir).where((F.col("instrument_id") + F.hour("ts_event")) % 3 > 0).withColumn("close", F.when(i == 3, -F.col("close")).otherwise(F.col("close")))
    g = fx.option_greeks(spark, sf_dir).where("T > 0")
    g = g.withColumns({"dte": F.when(i == 5, F.col("dte") - 40).otherwise(F.col("dte")), "iv": F.when(i == 1, F.lit(float("nan"))).when(i == 2, 10.0).when(i == 4, 3.0).otherwise(F.col("iv")), "delta": F.when(i == 6, -F.col("delta")).when(i == 7, 1.5).otherwise(F.col("delta"))})
    return b, g


@R.add(f"""WITH {_BAD}, f AS (
SELECT 'IV_NAN' AS flag_code, 'soft' AS flag_severity, instrument_id FROM og WHERE isnan(iv) UNION ALL SELECT 'IV_SENTINEL', 'soft', instrument_id FROM og WHERE iv = 10 UNION ALL SELECT 'IV_HIGH', 'soft', instrument_id FROM og WHERE iv > 2 AND NOT isnan(iv) AND iv <> 10
UNION ALL SELECT 'DELTA_INCONSISTENT', 'soft', instrument_id FROM gaps WHERE gap > 0.1
UNION ALL SELECT 'NEGATIVE_CLOSE', 'hard', instrument_id FROM ob WHERE close < 0 UNION ALL SELECT 'NEGATIVE_DTE', 'hard', instrument_id FROM og WHERE dte < 0 UNION ALL SELECT 'ZOMBIE_BAR', 'hard', instrument_id FROM ob WHERE expiration < CAST(ts_event AS DATE)
UNION ALL SELECT 'DELTA_SIGN_ERROR', 'hard', og.instrument_id FROM og JOIN ob USING (instrument_id, ts_event) WHERE (ob.right_ = 'P' AND delta > 0) OR (ob.right_ = 'C' AND delta < 0)
UNION ALL SELECT 'DELTA_MAGNITUDE_ERROR', 'hard', instrument_id FROM og WHERE abs(delta) > 1
UNION ALL (SELECT 'BARS_TRUNCATED', 'hard', instrument_id FROM ob GROUP BY instrument_id, expiration HAVING (expiration - max(CAST(ts_event AS DATE))) / NULLIF(expiration - min(CAST(ts_event AS DATE)), 0) > 0.15)
UNION ALL (SELECT 'BARS_SPARSE', 'soft', instrument_id FROM ob GROUP BY instrument_id, expiration HAVING count(*) / count(DISTINCT CAST(ts_event AS DATE)) < 10)
UNION ALL (SELECT 'NO_EXPIRY_BARS', 'soft', instrument_id FROM ob GROUP BY instrument_id, expiration HAVING count(*) FILTER (CAST(ts_event AS DATE) = expiration) = 0))
SELECT flag_code, flag_severity, count(*) AS n, count(DISTINCT instrument_id) AS n_instruments FROM f GROUP BY 1, 2""")
def audit_flag_counts(spark, sf_dir):
    """All twelve flags, U1, U3, A6-A9"""
    b, g = _bad(spark, sf_dir)
    return audit.flag_counts(audit.run(b, g, fx.underlying_bars(spark, sf_dir)))


@R.add(f"""WITH {_BAD} SELECT instrument_id, count(*) AS n, round(max(gap), 4) AS largest FROM gaps WHERE gap > 0.1 GROUP BY 1""")
def audit_delta(spark, sf_dir):
    """J22, K5, DELTA_INCONSISTENT of all instruments, also where a spoilt volatility contradicts the delta"""
    b, g = _bad(spark, sf_dir)
    found = audit.delta_flags(g, b, fx.underlying_bars(spark, sf_dir))
    return found.groupBy("instrument_id").agg(F.count("*").alias("n"), F.round(F.max("flag_value"), 4).alias("largest"))


#: Earlier names of the same queries.
for _name in ("audit_flag_counts", "audit_delta"):
    R.add(ORACLE_SQL[_name], f"{_name}_whole")(QUERIES[_name])


@R.add(f"""WITH {_BAD}, bad AS (SELECT DISTINCT instrument_id FROM ob WHERE close < 0 UNION SELECT instrument_id FROM og WHERE abs(delta) > 1)
SELECT instrument_id, count(*) AS n FROM ob WHERE instrument_id NOT IN (SELECT instrument_id FROM bad) GROUP BY 1""")
def audit_filter(spark, sf_dir):
    """J10, P40"""
    b, g = _bad(spark, sf_dir)
    flags = audit.integrity_flags(b, g)
    return audit.drop_flagged(b, flags, ["NEGATIVE_CLOSE", "DELTA_MAGNITUDE_ERROR"]).groupBy("instrument_id").agg(F.count("*").alias("n"))


_HARD = f"""{_BAD}, hard AS (SELECT instrument_id FROM ob WHERE close < 0 OR expiration < CAST(ts_event AS DATE) UNION SELECT instrument_id FROM og WHERE dte < 0 OR abs(delta) > 1
UNION SELECT og.instrument_id FROM og JOIN ob USING (instrument_id, ts_event) WHERE (ob.right_ = 'P' AND delta > 0) OR (ob.right_ = 'C' AND delta < 0)
UNION (SELECT instrument_id FROM ob GROUP BY instrument_id, expiration HAVING (expiration - max(CAST(ts_event AS DATE))) / NULLIF(expiration - min(CAST(ts_event AS DATE)), 0) > 0.15)),
soft AS (SELECT instrument_id FROM og WHERE isnan(iv) OR iv > 2 UNION SELECT instrument_id FROM gaps WHERE gap > 0.1
UNION (SELECT instrument_id FROM ob GROUP BY instrument_id, expiration HAVING count(*) / count(DISTINCT CAST(ts_event AS DATE)) < 10 OR count(*) FILTER (CAST(ts_event AS DATE) = expiration) = 0))"""


@R.add(f"""WITH {_HARD} SELECT 'hard_errors_only' AS preset, instrument_id, count(*) AS n FROM ob WHERE instrument_id NOT IN (SELECT * FROM hard) GROUP BY 2
UNION ALL SELECT 'all', instrument_id, count(*) FROM ob WHERE instrument_id NOT IN (SELECT * FROM hard UNION SELECT * FROM soft) GROUP BY 2 UNION ALL SELECT p, instrument_id, count(*) FROM ob CROSS JOIN (SELECT unnest(['none', 'unheard']) AS p) GROUP BY 1, 2""")
def audit_presets(spark, sf_dir):
    """Each preset, and one that isn't known"""
    b, g = _bad(spark, sf_dir)
    flags, out = audit.run(b, g, fx.underlying_bars(spark, sf_dir)), None
    for preset in ("hard_errors_only", "all", "none", "unheard"):
        rows = audit.drop_flagged(b, flags, preset).groupBy("instrument_id").agg(F.count("*").alias("n")).select(F.lit(preset).alias("preset"), "instrument_id", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


@R.add(f"""WITH {_BAD}, f AS (SELECT instrument_id, arg_min(delta, ts_event) AS d FROM og GROUP BY 1), r AS (SELECT instrument_id, min(right_) AS r FROM ob GROUP BY 1), bad AS (SELECT DISTINCT instrument_id FROM ob WHERE close < 0),
q AS (SELECT r, d, b.instrument_id AS f, ntile(5) OVER (PARTITION BY r ORDER BY d, f.instrument_id) AS quintile FROM f JOIN r USING (instrument_id) LEFT JOIN bad b ON b.instrument_id = f.instrument_id)
SELECT r AS "right", quintile, round(min(d), 6) AS low, round(max(d), 6) AS high, round(quantile_cont(d, 0.5), 6) AS median, count(*) AS n, count(f) AS n_flagged FROM q GROUP BY 1, 2""")
def audit_quintiles(spark, sf_dir):
    """W11, A10, A11, J30"""
    b, g = _bad(spark, sf_dir)
    flags = audit.integrity_flags(b, g).where("flag_code = 'NEGATIVE_CLOSE'")
    out = audit.quintiles(g, b, flags)
    return out.withColumns({c: F.round(c, 6) for c in ("low", "high", "median")}).withColumn("quintile", F.col("quintile").cast("long"))


_SMA = f"""{fx.BARS}, w AS (SELECT instrument_id, ts_event, CASE WHEN count(close) OVER s5 = 5 THEN avg(close) OVER s5 END AS sma_5, CASE WHEN count(close) OVER s20 = 20 THEN stddev_samp(close) OVER s20 END AS std_20 FROM bars
WINDOW s5 AS (PARTITION BY instrument_id ORDER BY ts_event ROWS 4 PRECEDING), s20 AS (PARTITION BY instrument_id ORDER BY ts_event ROWS 19 PRECEDING)),
tall AS (SELECT instrument_id, ts_event, 'sma_5' AS name, sma_5 AS value FROM w WHERE sma_5 IS NOT NULL UNION ALL SELECT instrument_id, ts_event, 'std_20', std_20 FROM w WHERE std_20 IS NOT NULL)"""


def _tall(spark, sf_dir):
    def compute(df):
        return df.withColumns({"sma_5": indicators.rolling("close", 5), "std_20": indicators.rolling("close", 20, "std")})

    return indicators.run(fx.bars(spark, sf_dir), compute)


@R.add(f"WITH {_SMA} SELECT instrument_id, {T('ts_event')} AS ts_event, name, round(value, 6) AS value FROM tall")
def indicator_run(spark, sf_dir):
    """I1, I2, W16"""
    return _tall(spark, sf_dir).select("instrument_id", fx.text("ts_event").alias("ts_event"), "name", F.round("value", 6).alias("value"))


@R.add(f"""WITH {_SMA}, old AS (SELECT DISTINCT CAST(instrument_id + 1 AS BIGINT) AS id, name, instrument_id FROM tall WHERE name = 'sma_5'), new AS (SELECT DISTINCT name, instrument_id FROM tall WHERE name <> 'sma_5'),
e AS (SELECT id, name, instrument_id FROM old UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY name, instrument_id), name, instrument_id FROM new)
SELECT e.id AS indicator_id, count(*) AS n, round(sum(value), 4) AS total FROM tall JOIN e USING (name, instrument_id) WHERE name <> 'sma_5' OR ts_event >= TIMESTAMP '2024-01-12' GROUP BY 1""")
def indicator_definitions(spark, sf_dir):
    """The store has the first days of one indicator already"""
    tall = _tall(spark, sf_dir)
    old = tall.where("name = 'sma_5'").select((F.col("instrument_id") + 1).alias("id"), "name", F.col("instrument_id").alias("underlying_id")).distinct()
    _, values = indicators.with_definitions(tall, old)
    stored = values.join(old.select(F.col("id").alias("indicator_id")), "indicator_id", "left_semi").where("ts_event < timestamp_ntz'2024-01-12 00:00:00'")
    return indicators.insert_absent(values, stored).groupBy("indicator_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@R.add(f"""WITH {_SMA} SELECT instrument_id AS underlying_id, {T('ts_event')} AS ts_event, round(max(CASE WHEN name = 'sma_5' THEN value END), 6) AS sma_5, round(max(CASE WHEN name = 'std_20' THEN value END), 6) AS std_20 FROM tall GROUP BY instrument_id, ts_event""")
def indicator_pivot(spark, sf_dir):
    """I7, I8"""
    tall = _tall(spark, sf_dir)
    defs = tall.select("name", F.col("instrument_id").alias("underlying_id")).distinct().withColumn("id", F.col("underlying_id") * 2 + F.when(F.col("name") == "sma_5", 0).otherwise(1))
    values = tall.withColumnRenamed("instrument_id", "underlying_id").join(defs, ["name", "underlying_id"]).select("ts_event", F.col("id").alias("indicator_id"), "value")
    out = indicators.wide(values, defs, ["sma_5", "std_20"])
    return out.select("underlying_id", fx.text("ts_event").alias("ts_event"), F.round("sma_5", 6).alias("sma_5"), F.round("std_20", 6).alias("std_20"))


@R.add(f"""WITH {_SMA}, d AS (SELECT DISTINCT instrument_id FROM tall WHERE name = 'sma_5'), v AS (SELECT instrument_id, max(ts_event) AS v FROM tall WHERE name = 'sma_5' AND ts_event < TIMESTAMP '2024-01-25' AND instrument_id < 5 GROUP BY 1
UNION ALL SELECT instrument_id, max(ts_event) FROM tall WHERE name = 'sma_5' AND instrument_id = 5 GROUP BY 1), b AS (SELECT instrument_id, max(ts_event) AS b FROM bars GROUP BY 1)
SELECT d.instrument_id AS id FROM d LEFT JOIN v USING (instrument_id) JOIN b USING (instrument_id) WHERE v IS NULL OR v < b""")
def indicator_stale(spark, sf_dir):
    """I5, I6"""
    tall = _tall(spark, sf_dir).where("name = 'sma_5'").withColumnRenamed("instrument_id", "indicator_id").drop("name")
    old = tall.where("(ts_event < timestamp_ntz'2024-01-25 00:00:00' and indicator_id < 5)")
    stored = old.unionByName(indicators.replace_window(tall.where("false"), tall.where("indicator_id = 5"), "2024-01-01 00:00:00", "2024-12-31 00:00:00"))
    defs = tall.select(F.col("indicator_id").alias("id"), F.col("indicator_id").alias("underlying_id")).distinct()
    return indicators.stale(stored, defs, fx.bars(spark, sf_dir)).select("id")


@R.add(f"""WITH {_SMA}, gap AS (SELECT instrument_id = 2 AND ts_event BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' AS here, * FROM tall)
SELECT instrument_id, name, count(*) AS n, round(sum(CASE WHEN here THEN value ELSE -1 END), 4) AS total FROM gap GROUP BY 1, 2""")
def indicator_recompute(spark, sf_dir):
    """A series that held -1 everywhere, recomputed for one contract's gap and the eight days behind it"""
    def compute(df):
        return df.withColumns({"sma_5": indicators.rolling("close", 5), "std_20": indicators.rolling("close", 20, "std")})

    stored = _tall(spark, sf_dir).withColumn("value", F.lit(-1.0))
    out = indicators.recompute(stored, fx.bars(spark, sf_dir), compute, 2, "2024-01-10 00:00:00", "2024-01-12 00:00:00", 8)
    return out.groupBy("instrument_id", "name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@R.add(f"""WITH {fx.CHAIN} SELECT instrument_id, count(*) AS n FROM chain WHERE dte BETWEEN 3 AND 15 AND delta BETWEEN -0.6 AND -0.2 AND right_ = 'P' GROUP BY 1""")
def option_context(spark, sf_dir):
    """P35, J4"""
    b = fx.option_bars(spark, sf_dir).select("instrument_id", "ts_event", "right")
    rows = fx.option_greeks(spark, sf_dir).join(b, ["instrument_id", "ts_event"])
    return indicators.option_context(rows, (3, 15), (-0.6, -0.2), "put").groupBy("instrument_id").agg(F.count("*").alias("n"))


@R.add("""WITH n AS (SELECT DISTINCT event_type, upper(substr(event_type, 1, 2)) || substr('FGHJKMNQUVXZ?', CAST(user_id % 13 + 1 AS INTEGER), 1) || user_id % 30 AS symbol FROM events)
SELECT event_type, symbol, upper(substr(event_type, 1, 1)) || substr(event_type, 2) || ' Event' AS title, CASE WHEN symbol LIKE '%?%' THEN '' ELSE substr(symbol, 1, 2) END AS root FROM n""")
def names_and_titles(spark, sf_dir):
    """Roots of all symbols, also of ones that are no contract"""
    month = F.substring(F.lit("FGHJKMNQUVXZ?"), (F.col("user_id") % 13 + 1).cast("int"), F.lit(1))
    e = fx.table(spark, sf_dir, "events").select("event_type", F.concat(F.upper(F.substring("event_type", 1, 2)), month, (F.col("user_id") % 30).cast("string")).alias("symbol")).distinct()
    return e.select("event_type", "symbol", title_case(F.concat("event_type", F.lit("_event"))).alias("title"), contract_root(F.col("symbol")).alias("root"))


@R.add(f"WITH {fx.BARS} SELECT {T('ts_event')} AS ts_event, open, high, low, close, volume FROM bars WHERE instrument_id = 3 AND ts_event BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12 12:00:00'")
def scan_one(spark, sf_dir):
    """One instrument's bars"""
    return scans.one(fx.bars(spark, sf_dir), 3, "2024-01-05 00:00:00", "2024-01-12 12:00:00").withColumn("ts_event", fx.text("ts_event"))


@R.add(f"WITH {fx.BARS} SELECT instrument_id, {T('ts_event')} AS ts_event, close, volume FROM bars WHERE instrument_id IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 1)")
def scan_many(spark, sf_dir):
    """The bars of a table of ids"""
    ids = fx.table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 1").select(F.col("s_suppkey").alias("instrument_id"))
    return scans.many(fx.bars(spark, sf_dir), ids, ("ts_event", "close", "volume")).withColumn("ts_event", fx.text("ts_event"))


@R.add(f"WITH {fx.CHAIN} SELECT DISTINCT CAST(instrument_id AS BIGINT) AS instrument_id, underlying_id FROM chain")
def option_underlyings(spark, sf_dir):
    """S15"""
    return scans.underlying_of(fx.option_bars(spark, sf_dir))


@R.add(f"WITH {fx.CHAIN} SELECT underlying_id AS instrument_id, count(*) AS n FROM hours WHERE underlying_id = 1 GROUP BY 1")
def scan_root(spark, sf_dir):
    """S16"""
    return scans.by_root(fx.underlying_bars(spark, sf_dir), "ESG").groupBy("instrument_id").agg(F.count("*").alias("n"))


@R.add(f"SELECT event_id, {T('ts')} AS ts_event, value AS close, CAST(NULL AS BIGINT) IS NULL AS no_volume FROM events WHERE value IS NOT NULL")
def decoded_bars(spark, sf_dir):
    """Fixed-point prices and nanoseconds, a column that older files lack"""
    e = fx.table(spark, sf_dir, "events").where("value is not null")
    coded = F.round(F.col("value") * 1e9).cast("long")
    raw = e.select("event_id", (clock.epoch_micros(fx.ntz("ts")) * 1000).alias("ts_event"), *(coded.alias(c) for c in ("open", "high", "low", "close")))
    out = ingest.heal(ingest.decode_bars(raw), {"volume": "long"})
    return out.select("event_id", fx.text("ts_event").alias("ts_event"), "close", F.col("volume").isNull().alias("no_volume"))


@R.add(f"""WITH {fx.CHAIN}, b AS MATERIALIZED (SELECT instrument_id, ts_event, close FROM chain WHERE t > 0)
SELECT c.instrument_id, {T('c.ts_event')} AS ts_event, c.dte, round(c.delta, 6) + 0.0 AS delta, round(b.close, 6) + 0.0 AS close FROM chain c JOIN b USING (instrument_id, ts_event)""")
def greeks_with_bars(spark, sf_dir):
    """Every greek with its bar"""
    b = fx.option_bars(spark, sf_dir).where("t > 0").select("instrument_id", "ts_event", "right", "close")
    g = fx.option_greeks(spark, sf_dir).join(b, ["instrument_id", "ts_event"])
    return g.select("instrument_id", fx.text("ts_event").alias("ts_event"), F.col("dte").cast("long").alias("dte"), (F.round("delta", 6) + 0.0).alias("delta"), (F.round("close", 6) + 0.0).alias("close"))

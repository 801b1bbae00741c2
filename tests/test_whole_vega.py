"""The vega series of all entries against brute force, and what the joins behind it make."""

from collections import defaultdict
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from optlattice.operators import exit
from optlattice.plans import catalog, fixtures, queries_backtest

DAY = lambda at: at.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo("America/New_York")).date()


def test_vega_of_all_entries(spark, sf_dir):
    vega = defaultdict(dict)
    for r in fixtures.option_greeks(spark, sf_dir).where("T > 0").collect():
        vega[r.instrument_id][r.ts_event] = r.vega
    want = defaultdict(float)
    for e in queries_backtest._entries(spark, sf_dir).collect():
        for leg in e.legs:
            for at, v in vega[leg.instrument_id].items():
                if at > e.entry_time and DAY(at) <= e.trade_expiration:
                    want[e.entry_id, at] += leg.signed_qty * v
    found = exit.spread_vega(queries_backtest._entries(spark, sf_dir), fixtures.option_greeks(spark, sf_dir).where("T > 0"))
    got = {(r.entry_id, r.ts_event): r.spread_vega for r in found.collect()}
    assert got.keys() == want.keys() and any(i % 10 for i, _ in got)
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())
    days = {(r.entry_id, r.day): r for r in catalog.QUERIES["spread_vega_whole"](spark, sf_dir).collect()}
    of_day = defaultdict(list)
    for (i, at), v in want.items():
        of_day[i, str(at.date())].append(v)
    assert days.keys() == of_day.keys() and all(days[k].n == len(v) and days[k].total == pytest.approx(sum(v), abs=2e-3) for k, v in of_day.items())


def test_joins_of_open_legs_make_little_beyond_what_stays(spark, sf_dir):
    """An entry of three days in a month of bars: by instrument alone a leg would meet all of them."""
    e, bars = queries_backtest._pairs(spark, sf_dir), fixtures.bars(spark, sf_dir)
    legs = e.select("entry_id", F.col("entry_time").alias("_from"), exit.end_of("trade_expiration", "America/New_York").alias("_to"), F.explode("legs").alias("l")).select("entry_id", "_from", "_to", "l.instrument_id")
    kept, made, by_instrument = exit.held(legs, bars).count(), exit.met(legs, bars).count(), legs.join(bars, "instrument_id").count()
    assert kept < made < 2 * kept and by_instrument > 4 * made

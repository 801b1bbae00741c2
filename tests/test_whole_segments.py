"""Routing and overlaps with many segments per id against brute force."""

import datetime as dt
import os
import random
from collections import defaultdict

import pytest

from optlattice.operators import ingest
from optlattice.plans import catalog, fixtures


def test_segments_of_all_suppliers(spark, sf_dir, tmp_path):
    os.symlink(f"{sf_dir}/events.parquet", f"{tmp_path}/events.parquet")
    keys = [*range(0, 300, 7), *range(40, 90, 3)]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    segments = defaultdict(list)
    for k in keys:
        start = dt.date(2024, 1, 1) + dt.timedelta(days=k % 20)
        segments[k % 8].append((start, start + dt.timedelta(days=3 + k % 5)))
    routed, twice = defaultdict(lambda: [0, 0, set()]), defaultdict(int)
    for b in fixtures.bars(spark, str(tmp_path)).collect():
        day, here = b.ts_event.date(), segments[b.instrument_id]
        away, _, start, _ = min((max(0, (a - day).days, (day - z).days), (z - a).days, a, z) for a, z in here)
        row = routed[b.instrument_id]
        row[0], row[1], row[2] = row[0] + 1, row[1] + away, row[2] | {start}
        twice[b.instrument_id] += sum(a <= day <= z for a, z in here) > 1
    got = {r.instrument_id: (r.n_bars, r.off_days, r.n_starts) for r in catalog.QUERIES["route_recycled_ids_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: (n, d, len(s)) for i, (n, d, s) in routed.items()}
    got = {r.instrument_id: r.bars for r in catalog.QUERIES["segment_overlaps_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: n for i, n in twice.items() if n} and got


@pytest.mark.parametrize("seed", range(20))
def test_stretches_by_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        ends = [(a, a + rng.choice([0, 1, 3, 10, 30])) for a in (rng.randint(0, 40) for _ in range(rng.randint(1, 8)))]
        segments = [(a, e, (e - a, a, e)) for a, e in ends]
        found = ingest._winners(segments)
        assert [d for d, _ in found] == sorted({d for d, _ in found}) and len(found) <= 4 * len(segments) + 1
        for day in range(-20, 90):
            chosen = [i for d, i in found if d <= day][-1]
            want = min((max(0, a - day, day - e), e - a, a, e) for a, e in ends)
            a, e = ends[chosen]
            assert (max(0, a - day, day - e), e - a, a, e) == want


def test_open_ends_and_missing_dates(spark):
    day = lambda d: d and dt.date(2024, 1, d)
    segments = spark.createDataFrame([(1, day(5), day(9), "a"), (1, day(15), None, "b"), (2, None, day(3), "c"), (3, day(9), day(5), "d")], "instrument_id long, seg_activation date, seg_expiration date, kind string")
    rows = [(1, day(1)), (1, day(12)), (1, day(13)), (1, dt.date(2030, 1, 1)), (1, None), (2, day(1)), (2, day(20)), (3, day(7)), (9, day(1))]
    bars = spark.createDataFrame([(i, d, str(d)) for i, d in rows], "instrument_id long, date date, ts_event string")
    got = {(r.instrument_id, r.date): (r.kind, r.seg_distance) for r in ingest.route(bars, segments).collect()}
    assert got == {(1, day(1)): ("a", 4), (1, day(12)): ("b", 3), (1, day(13)): ("b", 2), (1, dt.date(2030, 1, 1)): ("b", 0), (1, None): ("a", 0), (2, day(1)): ("c", 0), (2, day(20)): ("c", 17), (3, day(7)): ("d", 2)}
    assert ingest.overlaps(bars, segments).count() == 0

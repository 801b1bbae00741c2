"""Walks over all entries, also those that the SQL of the shorter queries leaves out, against plain loops."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from optlattice.plans import catalog


@pytest.fixture(scope="module")
def clicks(spark, tmp_path_factory):
    rng = random.Random(4)
    start = dt.datetime(2024, 1, 3)
    rows = [(i, rng.randint(0, 40), start + dt.timedelta(minutes=rng.randint(0, 6 * 1440)), rng.choice(["click", "click", "view"])) for i in range(3900, 4400)]
    root = tmp_path_factory.mktemp("clicks")
    df = spark.createDataFrame([(i, u, str(t), k) for i, u, t, k in rows], "event_id long, user_id long, ts string, event_type string")
    df.withColumn("ts", df["ts"].cast("timestamp_ntz")).write.parquet(f"{root}/events.parquet")
    groups = defaultdict(list)
    for i, u, t, kind in rows:
        if kind == "click":
            reason = "stop_loss" if i % 5 == 0 else "roll" if i % 7 == 0 else "expiry"
            groups[u % 4].append((t, i, t + dt.timedelta(minutes=30 + i % 300), reason))
    return str(root), {k: sorted(g) for k, g in groups.items()}


def walk(group, cap):
    gate, day, n, free, kept = None, None, 0, False, set()
    for t, i, end, reason in group:
        here, again = (n, free) if day == t.date() else (0, False)
        if (gate is None or t >= gate) and (here < cap or again):
            gate, day, n, free = end, t.date(), here if again else here + 1, reason == "roll"
            kept.add(i)
    return kept


def no_reentry(group):
    loss = defaultdict(lambda: dt.datetime.max)
    for t, _, end, reason in group:
        if reason == "stop_loss":
            loss[t.date()] = min(loss[t.date()], end)
    return {i for t, i, _, _ in group if t <= loss[t.date()]}


def capped(group, cap=3):
    n, last, kept = defaultdict(int), {}, set()
    for t, i, _, reason in group:
        n[t.date()] += last.get(t.date()) != "roll"
        last[t.date()] = reason
        kept |= {i} if n[t.date()] <= cap else set()
    return kept


@pytest.mark.parametrize("name,plain", [("greedy_walk", lambda g: walk(g, 2)), ("greedy_walk_grouped", lambda g: walk(g, 2)), ("one_at_a_time", lambda g: walk(g, 10**9)), ("no_reentry_after_loss", no_reentry), ("daily_cap", capped)])
def test_walk_over_all_entries(spark, clicks, name, plain):
    root, groups = clicks
    got = {(r.k, r.entry_id) for r in catalog.QUERIES[f"{name}_whole"](spark, root).collect()}
    assert got == {(k, i) for k, g in groups.items() for i in plain(g)} and max(got, key=lambda x: x[1])[1] >= 4000


def test_gate_times_of_all_entries(spark, clicks):
    root, groups = clicks
    want = {}
    for t, i, end, reason in (x for g in groups.values() for x in g):
        opening = dt.datetime.combine(end.date() + dt.timedelta(days={4: 3, 5: 2}.get(end.weekday(), 1)), dt.time(9, 30))
        want[i] = str(max(end + dt.timedelta(hours=10), opening) if reason == "stop_loss" else end)
    assert {r.entry_id: r.gate_time for r in catalog.QUERIES["gate_times_whole"](spark, root).collect()} == want

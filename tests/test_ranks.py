"""Order statistics by histogram refinement against sorted lists and native windows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from optlattice.operators import ranks


def table(spark, seed, n=600):
    rng = random.Random(seed)
    value = lambda: None if rng.random() < 0.02 else rng.choice([0.5, 0.5, 0.5, rng.gauss(0, 1), float(round(rng.gauss(0, 3))), 1e12 * rng.random()])
    return spark.createDataFrame([(rng.choice("aaab"), value(), 7 * i - 100, "clash") for i in rng.sample(range(n), n)], "k string, v double, id long, rank string")


@pytest.mark.parametrize(("seed", "last", "bins"), [(1, 3, 4), (2, 20, 16), (3, 10_000, 1024)])
def test_order_statistics_and_tiles(spark, monkeypatch, seed, last, bins):
    monkeypatch.setattr(ranks, "LAST_ROWS", last)
    monkeypatch.setattr(ranks, "BINS", bins)
    t = table(spark, seed).cache()
    groups = {k: sorted((r.v, r.id) for r in t.where("v is not null").collect() if r.k == k) for k in "ab"}
    wanted = spark.createDataFrame([(k, r) for k in "ab" for r in (0, 1, 50, 99, len(groups[k]) - 1)], "k string, rank long")
    for tie in ("id", None):
        got = {(r.k, r["rank"]): (r.value, r.tie) for r in ranks.order_statistics(t, ["k"], "v", wanted, tie).collect()}
        assert len(got) == 10
        for (k, r), (v, i) in got.items():
            assert v == groups[k][r][0] and (tie is None or i == groups[k][r][1])
    got = {r.k: r.m for r in ranks.medians(t, ["k"], "v", "m").collect()}
    assert got == {k: pytest.approx(np.median([v for v, _ in g])) for k, g in groups.items()}
    live = t.where("v is not null")
    for n in (3, 5, 40):
        want = live.withColumn("w", F.ntile(n).over(Window.partitionBy("k").orderBy("v", "id")))
        found = ranks.tiles(want, ["k"], "v", "id", n)
        assert found.where("tile != w").count() == 0 and found.count() == live.count()
        if seed < 3:
            break


def test_groups_of_one_value_and_none(spark):
    t = spark.createDataFrame([("a", 2.0, i) for i in range(50)] + [("b", None, 1), ("c", 1.0, 1)], "k string, v double, id long")
    assert {r.k: r.m for r in ranks.medians(t, ["k"], "v", "m").collect()} == {"a": 2.0, "b": None, "c": 1.0}
    got = {(r.k, r.id): r.tile for r in ranks.tiles(t.where("v is not null"), ["k"], "v", "id", 5).collect()}
    assert [got["a", i] for i in range(50)] == [1 + i // 10 for i in range(50)] and got["c", 1] == 1
    assert ranks.medians(t.limit(0), ["k"], "v", "m").count() == 0


def test_no_window_holds_a_group(spark):
    """The plans of the last step rank bounded ranges, not the groups."""
    t = spark.range(200_000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 100_003).cast("double").alias("v"), "id")
    bounds = ranks.order_statistics(t, ["k"], "v", spark.createDataFrame([(0, 40_000), (1, 77_777)], "k long, rank long"), "id").collect()
    for r in bounds:
        x = sorted((i * 7919 % 100_003, i) for i in range(r.k, 200_000, 2))
        assert (r.value, r.tie) == x[r["rank"]]

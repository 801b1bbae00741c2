"""Resampled figures send a key's profits to few tasks, whatever the number of trades."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from optlattice.operators import metrics


def trades(spark, n):
    rows = spark.range(n).select(F.col("id"), (F.col("id") % 3).alias("backtest_id"), F.expr("timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, cast(id * 7 % 50 as int))").alias("exit_time"), (F.col("id") * 7919 % 1009 - 400).cast("double").alias("net_pnl"))
    return rows.repartition(3)


@pytest.mark.parametrize(("draws", "piece", "piece_slices"), [(2_000_000, 65_536, 128), (300, 64, 2), (64, 32, 3)])
def test_means_do_not_depend_on_blocks(spark, monkeypatch, draws, piece, piece_slices):
    monkeypatch.setattr(metrics, "BLOCK_DRAWS", draws)
    monkeypatch.setattr(metrics, "PIECE", piece)
    monkeypatch.setattr(metrics, "SLICE", piece * piece_slices)
    t = trades(spark, 1000)
    got = {r.backtest_id: r for r in metrics.bootstrap_mean(t, n_boot=40).collect()}
    for key in range(3):
        x = np.array([r.net_pnl for r in sorted(t.where(F.col("backtest_id") == key).collect(), key=lambda r: (r.exit_time, r.id))])
        drawn = x[np.minimum((metrics.stream(40 * len(x)) * len(x)).astype(int), len(x) - 1)].reshape(40, len(x)).mean(axis=1)
        assert (got[key].mean_low, got[key].mean_high) == pytest.approx(tuple(np.quantile(drawn, (0.025, 0.975))))


def test_profits_are_sent_to_a_bounded_number_of_tasks(spark, monkeypatch):
    """With draws of a task's block fewer than a key's trades, each of 40 resamples had a copy of the key's profits."""
    monkeypatch.setattr(metrics, "BLOCK_DRAWS", 300)
    out = metrics.bootstrap_mean(trades(spark, 3000), n_boot=40)
    out.collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)

    def sizes(node):
        """Bytes written by shuffles below a node of the final plan."""
        if node.nodeName() == "AdaptiveSparkPlan":
            return sizes(node.executedPlan())
        if node.nodeName().endswith("QueryStage"):
            return sizes(node.plan())
        here = node.metrics().get("dataSize")
        children = node.children()
        return (here.get().value() if node.nodeName() == "Exchange" and here.isDefined() else 0) + sum(sizes(children.apply(i)) for i in range(children.size()))

    assert 0 < sizes(out._jdf.queryExecution().executedPlan()) < 3000 * 8 * 35

"""The cache of results."""

import pytest
from pyspark.sql import functions as F

from optlattice.sources.cache import ResultCache


def test_results_are_kept_until_a_row_changes(spark, tmp_path):
    place, calls = f"{tmp_path}/trades", []
    cache = ResultCache(spark, f"{tmp_path}/cache")

    def total(scale=1):
        trades = spark.read.parquet(place)

        def compute():
            calls.append(scale)
            return trades.groupBy("b").agg(F.sum(F.col("pnl") * scale).alias("total"))

        return {r.b: r.total for r in cache.get("totals", [trades], compute, scale=scale).collect()}

    rows = [(1, 2.0), (1, 3.0), (2, 5.0)]
    spark.createDataFrame(rows, "b int, pnl double").write.parquet(place)
    assert total() == total() == {1: 5.0, 2: 5.0} and calls == [1]
    assert total(2) == {1: 10.0, 2: 10.0} and total() == {1: 5.0, 2: 5.0} and calls == [1, 2]
    # an edit that keeps count, largest value and sum
    spark.createDataFrame([(1, 3.0), (2, 2.0), (2, 5.0)], "b int, pnl double").write.mode("overwrite").parquet(place)
    assert total() == {1: 3.0, 2: 7.0} and calls == [1, 2, 1]
    spark.createDataFrame([(3, 1.0)], "b int, pnl double").write.mode("append").parquet(place)
    assert total()[3] == 1.0 and len(calls) == 4
    kept = [p for p in (tmp_path / "cache").iterdir()]
    assert len(kept) == 2 and all(len(list(p.iterdir())) == 1 for p in kept)  # older results are gone
    cache.forget("totals")
    assert not list((tmp_path / "cache").iterdir()) and total()[3] == 1.0 and len(calls) == 5
    with pytest.raises(ValueError, match="stored tables"):
        cache.get("x", [spark.range(3)], lambda: spark.range(3))

"""Connected components of links between ids, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import forget, save


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id in a link, the smallest id that it reaches. Null ends and links of an id with itself don't count.

    Each round ties the larger neighbours of every id to its smallest neighbour, then its smaller ones (large and
    small star). The rounds grow with the logarithm of the longest path. Every round is a written table, so lost
    executors cost one round at most; links and labels stay on the executors.
    """
    edges = save(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "components-links")
    mark = _mark(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        first = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(first, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        used, edges = edges, save(small.unionByName(first.select("hi", F.col("m").alias("lo"))).distinct(), "components-round")
        forget(used)
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """Two equal edge sets have equal marks; unequal ones practically never."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first())

"""Exact order statistics of distributed groups: quantiles and tiles without a task that holds a group."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges that a pass counts, and rows of a range that are ranked together in the end.
BINS, LAST_ROWS = 1_024, 10_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Only a local master may leave it unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder or "file://" + tempfile.mkdtemp(prefix="optlattice-")


def kept(df: DataFrame) -> DataFrame:
    """Rows that several steps use, as a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _narrowed(rows: DataFrame, state: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The state after one more pass: each range is cut into BINS, counted, and the one that holds the rank becomes the range."""
    width = F.col("_hi") - F.col("_lo")
    within = rows.join(state, keys).where(F.col(value).between(F.col("_lo"), F.col("_hi")))
    cell = F.when(width > 0, F.least(F.lit(BINS - 1), F.floor((F.col(value) - F.col("_lo")) / width * BINS))).otherwise(0)
    by = [*keys, "_rank", "_before"]
    counted = within.groupBy(*by, cell.alias("_cell")).agg(F.count("*").alias("_n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    order = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_n").over(order), F.lit(0)))
    found = counted.where((F.col("_first") <= F.col("_rank")) & (F.col("_rank") < F.col("_first") + F.col("_n")))
    return found.select(*keys, "_rank", F.col("_first").alias("_before"), "_n", "_lo", "_hi")


def _located(rows: DataFrame, state: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The state when each range is a single value or has few rows."""
    for _ in range(64):
        left = state.where((F.col("_n") > LAST_ROWS) & (F.col("_lo") < F.col("_hi")))
        if left.isEmpty():
            break
        state = kept(_narrowed(rows, left, keys, value).unionByName(state.where((F.col("_n") <= LAST_ROWS) | (F.col("_lo") == F.col("_hi")))))
    return state


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, tie: str | None = None) -> DataFrame:
    """(keys, rank, value, tie): the row of each wanted rank, from 0, of each group by value, then tie.

    ranks has (keys, rank). Values are finite numbers; nulls don't count. A pass counts the rows of value ranges, the range with the wanted rank is cut
    again, and only the few rows of the last one are ranked. Where one value fills the range, its rows are told apart in the same way by the
    tie, a number. What passes hand on has one row per group and rank.
    """
    keys = list(keys)
    named = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    by = [f"_k{i}" for i in range(len(keys))]
    rows = rows.where(F.col(value).isNotNull()).select(*named, F.col(value).alias("_v"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("_t"))
    whole = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    state = kept(ranks.select(*named, F.col("rank").cast("long").alias("_rank")).distinct().join(whole, by).select(*by, "_rank", F.lit(0).cast("long").alias("_before"), "_n", "_lo", "_hi"))
    state = _located(rows, state, by, "_v")
    if tie:
        single = state.where((F.col("_lo") == F.col("_hi")) & (F.col("_n") > LAST_ROWS))
        few = state.where((F.col("_lo") < F.col("_hi")) | (F.col("_n") <= LAST_ROWS))
        of_value = single.select(*by, F.col("_lo").alias("_v")).distinct()
        alike = rows.join(of_value, [*by, "_v"])
        ends = alike.groupBy(*by, "_v").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
        tied = single.withColumnRenamed("_lo", "_v").drop("_hi").join(ends, [*by, "_v"]).select(*by, "_v", "_rank", "_before", "_n", "_lo", "_hi")
        tied = _located(alike, kept(tied), [*by, "_v"], "_t")
        low = F.struct(F.col("_v").alias("v"), F.col("_lo").alias("t")), F.struct(F.col("_v").alias("v"), F.col("_hi").alias("t"))
        state = tied.select(*by, "_rank", "_before", low[0].alias("_a"), low[1].alias("_b")).unionByName(_with_ends(few, by))
    else:
        state = _with_ends(state, by)
    place = F.struct(F.col("_v").alias("v"), F.col("_t").alias("t"))
    last = rows.join(state, by).where((place >= F.col("_a")) & (place <= F.col("_b")))
    if not tie:  # equal values are the same
        last = last.groupBy(*by, "_rank", "_before", "_v", "_t").agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*by, "_rank").orderBy("_v")) + F.col("_before")
        last = last.withColumn("_r", upto).where((F.col("_rank") < F.col("_r")) & (F.col("_rank") >= F.col("_r") - F.col("_c")))
    else:
        order = Window.partitionBy(*by, "_rank").orderBy("_v", "_t")
        last = last.withColumn("_r", F.row_number().over(order) - 1 + F.col("_before")).where(F.col("_r") == F.col("_rank"))
    return last.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), F.col("_rank").alias("rank"), F.col("_v").alias("value"), F.col("_t").alias("tie"))


def _with_ends(state: DataFrame, by: Sequence[str]) -> DataFrame:
    low, high = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)
    return state.select(*by, "_rank", "_before", F.struct(F.col("_lo").alias("v"), low.alias("t")).alias("_a"), F.struct(F.col("_hi").alias("v"), high.alias("t")).alias("_b"))


def medians(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(keys, name): the exact median of each group, the mean of the two middle values of an even number; null for a group without values."""
    keys = list(keys)
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("_n"))
    half = F.col("_n") - 1
    both = F.array((half / 2).cast("long"), ((half + 1) / 2).cast("long"))
    wanted = sizes.where("_n > 0").select(*keys, F.explode(F.array_distinct(both)).alias("rank"))
    found = order_statistics(rows, keys, value, wanted).groupBy(*keys).agg(F.avg("value").alias(name))
    on = [sizes[k].eqNullSafe(found[k]) for k in keys]
    return sizes.join(found, on, "left").select(*(sizes[k] for k in keys), name)


def tiles(rows: DataFrame, keys: Sequence[str], value: str, tie: str, n: int) -> DataFrame:
    """Adds `tile`, from 1 to n, as ntile(n) over each group by value, then tie (unique numbers) does: the first tiles are the larger ones."""
    keys = list(keys)
    size = F.col("_n")
    begin = lambda t: (F.floor(size / n) * t + F.least(size % n, F.lit(t))).cast("long")
    sizes = rows.groupBy(*keys).agg(F.count(value).alias("_n"))
    wanted = sizes.select(*keys, "_n", F.explode(F.array(*(begin(t) for t in range(1, n)))).alias("rank")).where(F.col("rank") < size)
    bounds = order_statistics(rows, keys, value, wanted, tie)
    place: Column = F.struct(F.col("value").alias("v"), F.col("tie").alias("t"))
    per = bounds.groupBy(*keys).agg(F.array_sort(F.collect_list(place)).alias("_bounds"))
    own = F.struct(F.col(value).alias("v"), F.col(tie).cast("long").alias("t"))
    return rows.join(per, keys, "left").withColumn("tile", F.coalesce(F.size(F.filter("_bounds", lambda b: b <= own)), F.lit(0)) + 1).drop("_bounds")

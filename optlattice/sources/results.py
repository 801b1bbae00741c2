"""Result tables: parquet folders partitioned by backtest_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import pnl
from ..operators.ranks import kept

TABLES = ("backtest", "position", "position_leg", "position_continuation", "backtest_tag")


def append(rows: DataFrame, root: str, table: str) -> None:
    rows.write.mode("append").partitionBy("backtest_id").parquet(f"{root}/{table}")


def read(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{root}/{table}")


def overwrite_backtests(rows: DataFrame, root: str, table: str) -> None:
    """Replaces the backtests in rows and leaves the others alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("backtest_id").parquet(f"{root}/{table}")


def without(table: DataFrame, backtests: DataFrame) -> DataFrame:
    """A table's rows of all other backtests: the cascade applies it to each table."""
    return table.join(backtests.select("backtest_id"), "backtest_id", "left_anti")


def latest(rows: DataFrame, key: str = "backtest_id", version: str = "updated_at") -> DataFrame:
    """The last written row of each key."""
    order = Window.partitionBy(key).orderBy(F.col(version).desc())
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def set_equity(backtests: DataFrame, equity: float, study_id: int | None = None, backtest_id: int | None = None) -> DataFrame:
    """Sets initial_equity for all, one study's or one backtest; `changed` marks the affected rows."""
    hit = F.lit(True)
    hit = hit & (F.col("study_id") == study_id) if study_id is not None else hit
    hit = hit & (F.col("backtest_id") == backtest_id) if backtest_id is not None else hit
    hit = F.coalesce(hit, F.lit(False))
    return backtests.withColumn("initial_equity", F.when(hit, float(equity)).otherwise(F.col("initial_equity"))).withColumn("changed", hit)


_POSITION = ("id", "backtest_id", "trade_name", "open_time", "exit_time", "exit_reason", "open_mark", "exit_mark", "worst_mark", "slippage_cost", "fee_cost", "net_pnl")
_CONTINUATION = ("entry_price", "exit_time", "exit_price", "exit_reason", "pnl")


def run_tables(closed: DataFrame, first_ids: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The tables position, position_leg and position_continuation of closed positions with a backtest_id.

    Ids go on from first_ids (1 where there is none), by backtest, entry time, trade and entry, and are counted per backtest and day first. Legs and
    continuations carry the id of their position; a position without a continuation has no row there. Positions are
    kept: three tables are made of them.
    """
    first = {t: (first_ids or {}).get(t, 1) for t in ("position", "position_leg", "position_continuation")}
    bucket = F.struct("backtest_id", F.to_date("entry_time").alias("day"))
    rows = pnl.with_ids(closed.withColumn("_day", bucket), ["entry_time", "trade_name", "entry_id"], first["position"], "id", "_day")
    rows = kept(rows.withColumn("id", F.col("id").cast("long")))
    position = rows.withColumnRenamed("entry_time", "open_time").select(*_POSITION)
    legs = rows.select("_day", "backtest_id", F.col("id").alias("position_id"), F.posexplode("legs").alias("leg_index", "_leg")).select("_day", "backtest_id", "position_id", "leg_index", "_leg.*")
    action = F.when(F.col("signed_qty") > 0, "STO").otherwise("BTO")
    legs = pnl.with_ids(legs, ["position_id", "leg_index"], first["position_leg"], "id", "_day").withColumns({"id": F.col("id").cast("long"), "action": action, "quantity": F.abs("signed_qty")})
    legs = legs.withColumnRenamed("close", "open_price").drop("_day", "signed_qty", "leg_index").withColumn("exit_price", F.lit(None).cast("double"))
    more = rows.where("continuation_exit_time is not null").select("_day", "backtest_id", F.col("id").alias("position_id"), *(f"continuation_{c}" for c in _CONTINUATION))
    more = pnl.with_ids(more, ["position_id"], first["position_continuation"], "id", "_day").withColumn("id", F.col("id").cast("long")).drop("_day")
    return {"position": position, "position_leg": legs, "position_continuation": more}


def store_run(closed: DataFrame, root: str) -> dict[str, int]:
    """Appends run_tables() to the stored tables, with ids after theirs; the rows appended to each."""
    spark, first, counts = closed.sparkSession, {}, {}
    for table in ("position", "position_leg", "position_continuation"):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{table}")
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            first[table] = (read(spark, root, table).agg(F.max("id")).first()[0] or 0) + 1
    for table, rows in run_tables(closed, first).items():
        counts[table] = rows.count()
        if counts[table]:
            append(rows, root, table)
    return counts


def merge(parts: list[DataFrame], id_col: str = "id") -> DataFrame:
    """All parts in one table with ids that go on from part to part; old_id and part tell where a row came from."""
    out = None
    for k, part in enumerate(parts):
        rows = part.withColumns({"part": F.lit(k), "old_id": F.col(id_col)})
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    tops = out.groupBy("part").agg(F.max("old_id").alias("_top"))
    before = tops.select("part", F.coalesce(F.sum("_top").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return out.join(F.broadcast(before), "part").withColumn(id_col, F.col("old_id") + F.col("_before")).drop("_before")


def merge_tags(parts: list[DataFrame]) -> DataFrame:
    """(tag_id, name): one tag per name over all parts."""
    out = None
    for part in parts:
        out = part.select("name") if out is None else out.unionByName(part.select("name"))
    return out.distinct().withColumn("tag_id", F.row_number().over(Window.orderBy("name")))


def with_tags(backtests: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """Adds the sorted names of each backtest's tags; none: an empty array."""
    named = links.join(tags, "tag_id").groupBy("backtest_id").agg(F.sort_array(F.collect_set("name")).alias("tags"))
    return backtests.join(named, "backtest_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def study_overview(backtests: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per study: backtests by status, best Sharpe, trades, and the strategies and tags that occur."""
    rows = backtests.join(metrics, "backtest_id", "left")
    return rows.groupBy("study_id").agg(
        F.count("*").alias("n_backtests"),
        F.count_if(F.col("status") == "complete").alias("n_complete"),
        F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.max("sharpe").alias("best_sharpe"),
        F.sum("n_trades").alias("n_trades"),
        F.sort_array(F.collect_set("strategy_name")).alias("strategies"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"),
    )

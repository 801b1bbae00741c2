"""Streams of bars: incremental append without repeats, and tumbling buckets with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def source(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def without_repeats(bars: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each (instrument_id, ts_event) once, as long as repeats come within the delay."""
    return bars.withWatermark("ts_event", delay).dropDuplicatesWithinWatermark(["instrument_id", "ts_event"])


def buckets(bars: DataFrame, size: str = "5 minutes", delay: str | None = "1 hour") -> DataFrame:
    """Open, high, low, close and volume per instrument and bucket of up to a day; bars later than the delay are left out.

    Without a delay the one that an earlier step has set holds.
    """
    bars = bars.withWatermark("ts_event", delay) if delay else bars
    grouped = bars.groupBy("instrument_id", F.window("ts_event", size).alias("w"))
    out = grouped.agg(F.min_by("open", "ts_event").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts_event").alias("close"), F.sum("volume").alias("volume"))
    return out.select("instrument_id", F.col("w.start").alias("bucket"), "open", "high", "low", "close", "volume")


def append_available(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends all that is there now and stops; the next call goes on from there."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(folder)

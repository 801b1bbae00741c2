"""Streams against the same operator over the whole table."""

import random

from pyspark.sql import functions as F

from optlattice.operators import exit
from optlattice.streaming import bars, volume

SCHEMA = "entry_id long, ts_event timestamp, min_leg_volume long"


def test_rolling_volume_as_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(4)
    rows = [(e, f"2024-01-02 {9 + k // 60:02d}:{k % 60:02d}:00", rng.choice([None, 0, 1, 5])) for e in range(6) for k in rng.sample(range(240), 60)]
    # four files by time, but bars come up to 50 minutes late
    rows.sort(key=lambda r: (r[1], r[0]))
    minute = lambda r: int(r[1][11:13]) * 60 + int(r[1][14:16]) - 540
    files = [[] for _ in range(4)]
    for r in rows:
        files[min(3, (minute(r) + rng.choice([0, 0, 45])) // 60)].append(r)
    assert any(minute(r) < 60 * k for k, part in enumerate(files) for r in part)
    files.append([(99, "2024-01-03 09:00:00", 1)])  # moves the watermark past all of them
    table = lambda x: spark.createDataFrame(x, SCHEMA.replace("timestamp", "string")).withColumn("ts_event", F.col("ts_event").cast("timestamp"))
    for k, part in enumerate(files):
        table(part).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    for k in range(5):  # one file after the other, as an incremental run each
        source = bars.source(spark, f"{tmp_path}/in/{{{','.join(map(str, range(k + 1)))},x}}", SCHEMA)
        bars.append_available(volume.rolling_volume(source, 90), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    got = sorted((r.entry_id, r.ts_event, r.volume) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    whole = table(rows).withColumns({"ts_event": F.col("ts_event").cast("timestamp_ntz"), "min_leg_volume": F.coalesce("min_leg_volume", F.lit(0))})
    want = sorted((r.entry_id, r.ts_event, r.v) for r in whole.select("entry_id", "ts_event", exit.rolling_volume(90).alias("v")).collect())
    assert got == want and len(got) == 360

import zipfile

from pyspark.sql import functions as F

from optlattice.sources import files, results
from optlattice.streaming import bars


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ohlcv-1.csv", "id,close\n1,2.5\n2,3.5\n")
        z.writestr("definition.csv", "x\n1\n")
    folder = str(tmp_path)
    assert files.archive_members(spark, folder).count() == 2
    rows = files.archive_rows(spark, folder, "id long, close double", "ohlcv*.csv").orderBy("id").collect()
    assert [(r.id, r.close) for r in rows] == [(1, 2.5), (2, 3.5)]


def test_upload(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("Timestamp,Profit\n2024-01-02,$1.5\n01/03/2024,-2\nsoon,3\n2024-01-04 10:00:00,x\n")
    got = [(str(r.ts), r.pnl) for r in files.read_upload(spark, str(path)).orderBy("ts").collect()]
    assert got == [("2024-01-02 00:00:00", 1.5), ("2024-01-03 00:00:00", -2.0)]


def test_result_tables(spark, tmp_path):
    root = str(tmp_path)
    one = spark.createDataFrame([(1, 1, 5.0), (2, 1, 6.0), (3, 2, 7.0)], "id long, backtest_id long, net_pnl double")
    results.append(one, root, "position")
    results.overwrite_backtests(one.where("backtest_id = 2").withColumn("net_pnl", F.lit(9.0)), root, "position")
    stored = results.read(spark, root, "position")
    assert sorted((r.id, r.net_pnl) for r in stored.collect()) == [(1, 5.0), (2, 6.0), (3, 9.0)]
    assert results.without(stored, spark.createDataFrame([(1,)], "backtest_id long")).count() == 1
    merged = results.merge([one, one]).orderBy("id").collect()
    assert [r.id for r in merged] == [1, 2, 3, 4, 5, 6]
    assert files.compare_dumps(one, one).count() == 0
    counts = spark.createDataFrame([("A", "hard", 2, 1)], "flag_code string, flag_severity string, n long, n_instruments long")
    assert files.report(counts, "json") == '[{"flag_code":"A","flag_severity":"hard","n":2,"n_instruments":1}]'
    assert "A" in files.report(counts) and files.report(counts, "csv").startswith("flag_code,")


def test_streams(spark, tmp_path):
    schema = "instrument_id long, ts_event timestamp, open double, high double, low double, close double, volume long"
    rows = spark.createDataFrame([(1, "2024-01-01 10:00:00", 1.0, 3.0, 1.0, 2.0, 1), (1, "2024-01-01 10:00:00", 1.0, 3.0, 1.0, 2.0, 1), (1, "2024-01-01 10:04:00", 2.0, 5.0, 2.0, 4.0, 2), (1, "2024-01-01 15:00:00", 2.0, 5.0, 2.0, 4.0, 2)], schema.replace("timestamp", "string")).withColumn("ts_event", F.col("ts_event").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = bars.source(spark, f"{tmp_path}/in", schema)
    bars.append_available(bars.without_repeats(stream), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
    bars.append_available(bars.buckets(bars.without_repeats(stream), delay=None), f"{tmp_path}/agg", f"{tmp_path}/c2").awaitTermination(60)
    got = [(r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(f"{tmp_path}/agg").collect()]
    assert got == [(1.0, 5.0, 1.0, 4.0, 3)]


def test_latin_1_uploads(spark, tmp_path):
    from optlattice.sources import files

    for encoding in ("latin-1", "utf-8"):
        (tmp_path / f"{encoding}.csv").write_bytes("Date,Note,PnL\n2024-01-02,caf\u00e9,$1.50\nbad,x,1\n2024-01-03,,-2\n".encode(encoding))
        assert [r.pnl for r in files.read_upload(spark, f"{tmp_path}/{encoding}.csv").orderBy("ts").collect()] == [1.5, -2.0]


def test_dumps_with_different_columns(spark):
    from optlattice.sources import files

    old = spark.createDataFrame([(1, 2), (2, 3)], "id int, a int")
    new = spark.createDataFrame([(1, 2, None), (2, 3, "x")], "id int, a int, b string")
    assert sorted((r.side, r.id, r.b) for r in files.compare_dumps(old, new).collect()) == [("new", 2, "x"), ("old", 2, None)]

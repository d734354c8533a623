import os
import time

from pyspark.sql import functions as F

from recordspark.streaming import windows

SCHEMA = "ts timestamp, k int, v double"


def fed(spark, at, parts):
    """A stream that gets each of parts as a file of its own, in order."""
    for i, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "ts string, k int, v double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(f"{at}/once-{i}")
        (name,) = (x for x in os.listdir(f"{at}/once-{i}") if x.endswith(".parquet"))
        os.makedirs(f"{at}/in", exist_ok=True)
        os.rename(f"{at}/once-{i}/{name}", f"{at}/in/{i}.parquet")
        os.utime(f"{at}/in/{i}.parquet", (time.time() - 100 + i, time.time() - 100 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")


def all_of(stream, name, mode):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()


PARTS = [
    [("2024-01-01 10:00:00", 1, 1.0), ("2024-01-01 10:30:00", 1, 2.0)], [("2024-01-01 12:00:00", 1, 4.0), ("2024-01-01 11:55:00", 2, 8.0)], [("2024-01-01 12:01:00", 1, 0.5)],
    [("2024-01-01 10:01:00", 1, 16.0), ("2024-01-01 11:57:00", 2, 32.0)], [("2024-01-01 15:00:00", 1, 64.0)], [("2024-01-01 18:00:00", 1, 128.0)],
]


def test_late_rows_are_dropped_and_slightly_late_ones_are_not(spark, tmp_path):
    out = windows.windowed(fed(spark, tmp_path, PARTS), "ts", "1 hour", [F.sum("v").alias("v")], ["k"], delay="10 minutes")
    all_of(out, "late", "append")
    rows = {(r.window_start.hour, r.k): r.v for r in spark.table("late").collect()}
    # 10:01 comes when all before 11:50 is closed; 11:57 is within the delay
    assert rows == {(10, 1): 3.0, (11, 2): 40.0, (12, 1): 4.5, (15, 1): 64.0}


def test_sliding_windows_and_sessions_agree_with_tables(spark, tmp_path):
    rows = [[(f"2024-01-01 {10 + i // 3:02d}:{i % 3 * 15:02d}:00", i % 2, float(i))] for i in range(12)] + [[("2024-01-02 10:00:00", 0, 0.0)]]
    stream, table = fed(spark, tmp_path, rows), spark.createDataFrame([r for x in rows for r in x], "ts string, k int, v double").withColumn("ts", F.to_timestamp("ts"))
    total = [F.sum("v").alias("v"), F.count(F.lit(1)).alias("n")]
    for name, use in (("slid", lambda df: windows.windowed(df, "ts", "1 hour", total, ["k"], slide="30 minutes")), ("sess", lambda df: windows.sessions(df, "ts", "40 minutes", total, ["k"]))):
        all_of(use(stream), name, "append")
        closed = {tuple(r) for r in spark.table(name).collect()}
        whole = {tuple(r) for r in use(table).collect()}
        assert closed and closed == {r for r in whole if r[0].day == 1}  # the last day's are open yet


def test_first_rows_of_keys(spark, tmp_path):
    out = windows.distinct_stream(fed(spark, tmp_path, [[("2024-01-01 10:00:00", 1, 1.0)], [("2024-01-01 10:01:00", 1, 2.0), ("2024-01-01 10:02:00", 2, 3.0)]]), ["k"], "ts")
    all_of(out, "firsts", "append")
    assert sorted((r.k, r.v) for r in spark.table("firsts").collect()) == [(1, 1.0), (2, 3.0)]

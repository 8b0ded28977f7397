"""The streaming extensions against their batch forms."""

import datetime as dt

from trendloom.operators.cleaning import alpha_beta_values
from trendloom.streaming import filters

import numpy as np


def drain(q):
    q.processAllAvailable()
    q.stop()


def test_alpha_beta_keeps_state_between_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("ab"[i % 2], start + dt.timedelta(minutes=i), float(i * i % 17)) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "k string, ts timestamp, v double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp, v double").option("maxFilesPerTrigger", 10).parquet(f"{tmp_path}/in")
    drain(filters.alpha_beta_stream(stream, "k", "ts", "v").writeStream.format("memory").queryName("ab").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start())
    got = spark.table("ab").collect()
    for k in "ab":
        want = alpha_beta_values(np.array([v for x, _, v in rows if x == k]))
        assert [r.y_clean for r in sorted((r for r in got if r.series_id == k), key=lambda r: r.at)] == want.tolist()


def test_window_means_close_behind_the_watermark(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(hours=6 * i), float(i)) for i in range(20)]
    spark.createDataFrame(rows, "k string, ts timestamp, v double").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, ts timestamp, v double").parquet(f"{tmp_path}/in")
    drain(filters.window_means(stream, "k", "ts", "v").writeStream.format("memory").queryName("wm").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start())
    got = {r.start.day: (r.y, r.n) for r in spark.table("wm").collect()}
    assert got and all(v == (4 * (d - 1) + 1.5, 4) for d, v in got.items())

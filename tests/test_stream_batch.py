"""The streaming online features equal their batch twin; streaming windows
equal the batch aggregation."""

import pytest
from pyspark.sql import functions as F

from faultline.sources import fixtures as FX
from faultline.streaming import ops

from conftest import SF0001


def test_online_features_stream_equals_batch(spark):
    t = FX.telemetry(spark, SF0001)
    path = ops.write_request_log(t, n_files=4)
    out, prog = ops.run_to_table(ops.stream_features(ops.read_request_stream(spark, path)), "t_online")
    s = spark.read.parquet(out)
    b = ops.online_features_batch(t)
    j = s.join(b, "event_id").collect()
    assert len(j) == t.count() and len(prog) >= 4
    cols = ["rt_mean", "rt_std", "err_rate", "err_vol", "lag1_rt", "lag5_rt", "ema10_slice", "latency_slope"]
    sc = s.columns
    sj = s.alias("s").join(b.alias("b"), "event_id")
    for c in cols:
        bad = sj.filter(F.abs(F.col(f"s.{c}") - F.col(f"b.{c}")) > 1e-9 * (F.abs(F.col(f"b.{c}")) + 1)).count()
        assert bad == 0, c
    assert sc


def test_stream_windows_equal_batch(spark):
    t = FX.telemetry(spark, SF0001)
    path = ops.write_request_log(t, n_files=3)
    out, _ = ops.run_to_table(ops.error_windows(ops.read_request_stream(spark, path), "1 minute",
                                                watermark="1 hour"), "t_win", "update")
    s = ops.latest_per_key(spark.read.parquet(out), ["window_start", "api_name"])
    b = (t.groupBy(F.date_trunc("minute", "timestamp").cast("timestamp").alias("window_start"), "api_name")
         .agg(F.count(F.lit(1)).alias("requests")))
    assert s.select("window_start", "api_name", "requests").exceptAll(b).count() == 0
    assert s.count() == b.count()


def test_unordered_rows_of_one_key_in_one_batch(spark):
    """More rows than an Arrow batch holds, newest first."""
    from faultline.session import scratch_dir
    rows = spark.range(30_000).select(
        F.col("id").alias("event_id"), F.lit("a").alias("api_name"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("timestamp"),
        (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 37.0).alias("response_time"), F.when(F.col("id") % 7 == 0, 0).otherwise(1).alias("success"))
    path = scratch_dir(spark, "unordered")
    rows.orderBy(F.col("event_id").desc()).coalesce(1).write.option("timestampFormat", ops.TS_FORMAT).json(path)
    s = ops.read_request_stream(spark, path)
    base = scratch_dir(spark, "unordered_run")
    out, _ = ops.run_to_table(ops.stream_features(s), "unordered", base=base)
    j = spark.read.parquet(out).alias("s").join(ops.online_features_batch(rows).alias("b"), "event_id")
    assert j.count() == 30_000
    for c in ["rt_mean", "rt_std", "err_rate", "lag1_rt", "lag5_rt", "ema10_slice", "latency_slope"]:
        assert j.filter(F.abs(F.col(f"s.{c}") - F.col(f"b.{c}")) > 1e-9 * (F.abs(F.col(f"b.{c}")) + 1)).count() == 0, c
    assert j.where("n_seen <> event_id + 1").count() == 0
    # a restart over the same folders adds nothing
    ops.run_to_table(ops.stream_features(ops.read_request_stream(spark, path)), "unordered", base=base)
    assert spark.read.parquet(out).count() == 30_000

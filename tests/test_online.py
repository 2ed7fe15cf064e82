"""Streamed online features with late rows equal one sorted pass."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from faultline.session import scratch_dir
from faultline.sources import fixtures as FX
from faultline.streaming import online, ops, ordered

from conftest import SF0001


def late_log(spark, t, hours, files):
    """Files in order of arrival; a row arrives up to ``hours`` after its time."""
    t = t.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    lag = F.pmod(F.xxhash64("event_id"), F.lit(int(hours * 3600))).cast("long")
    path = scratch_dir(spark, "late")
    ops.write_in_order(t.withColumn("_at", F.unix_seconds("timestamp") + lag), path, "_at", files)
    return path


def test_rows_late_across_batches_equal_one_sorted_pass(spark):
    t = FX.telemetry(spark, SF0001)
    path = late_log(spark, t, 20, 6)
    with ordered.rocksdb(spark):
        out, progress = ops.run_to_table(online.online_features(ops.read_request_stream(spark, path), "24 hours"), "online")
    got = {r.event_id: r for r in spark.read.parquet(out).collect()}
    assert len(progress) >= 6
    rows = sorted(((r.api_name, r.timestamp, r.event_id, r.response_time, r.success) for r in t.collect()))
    end = max(r[1] for r in rows) - dt.timedelta(hours=24)
    want = 0
    for api in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == api]
        ts = np.array([np.datetime64(r[1], "us").astype(np.int64) for r in mine])
        f, *_ = online.feature_rows(api, ts, np.array([r[3] for r in mine]), np.array([float(r[4]) for r in mine]), np.zeros((0, 2)), np.zeros(3), 0)
        for r, x in zip(mine, f.to_dict("records")):
            if r[1] < end:
                want += 1
                assert all(v == got[r[2]][c] or abs(v - got[r[2]][c]) < 1e-9 * (1 + abs(v)) for c, v in x.items() if v == v), r[2]
                assert (got[r[2]].hour is None) == (x["n_seen"] < 30)
    assert len(got) == want > 800

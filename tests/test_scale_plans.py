"""What decides time and memory on large tables, seen in plans of small ones."""

import datetime as dt
import subprocess
import sys

from pyspark.sql import functions as F

from faultline.operators import intervals, ml, series
from faultline.plans import q_models
from faultline.session import broadcast_if_small
from faultline.sources import fixtures as FX

from conftest import ROOT, SF0001


def test_beyond_the_bound_nothing_is_broadcast(spark):
    left = spark.range(100).withColumn("v", F.lit(1))
    small = spark.range(100).withColumn("w", F.lit(2))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan(left.join(broadcast_if_small(small), "id"))
    assert "BroadcastExchange" not in plan(left.join(broadcast_if_small(small, max_bytes=1), "id"))


def test_calendar_segments_are_shuffled(spark, monkeypatch):
    plans, real = [], intervals.reliable_checkpoint
    monkeypatch.setattr(intervals, "reliable_checkpoint", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    cal = spark.createDataFrame([(i, at(i), at(i + 5)) for i in range(20)], "seq int, start timestamp, end timestamp")
    got = {(r._from - 1704067200000000) // 3600000000: r._seq for r in intervals.winning_segments(cal).collect()}
    assert got[0] == 0 and got[7] == 7 and got[19] == 19
    assert "Join" in plans[-1] and "BroadcastExchange" not in plans[-1]


def test_scale_by_position_over_many_partitions(spark):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=(i * 37) % 500), float(i % 50)) for i in range(500)]
    t = spark.createDataFrame(rows, "event_id long, timestamp timestamp_ntz, response_time double")
    for n in (1, 8, 24, 200):
        idx = series.with_row_index(t, key=None, order=("timestamp", "event_id"), idx_col="pos", n_partitions=n)
        got = {r.event_id: r.response_time_z for r in ml.standard_scale(idx, ["response_time"], F.col("pos") < 400, suffix="_z").collect()}
        first = [v for _, _, v in sorted(rows, key=lambda r: (r[1], r[0]))[:400]]
        mean = sum(first) / 400
        sd = (sum((v - mean) ** 2 for v in first) / 400) ** .5
        assert len(got) == 500 and all(abs(got[i] - (v - mean) / sd) < 1e-9 for i, _, v in rows)


FRESH = """
import sys, tempfile
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession, functions as F
from faultline.operators import ml, series
from faultline.sources import fixtures as FX
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="faultline-test-ckpt-", dir="/tmp")).getOrCreate())
t = FX.telemetry(spark, sys.argv[2]).select("event_id", "timestamp", "response_time")
idx = series.with_row_index(t, key=None, order=("timestamp", "event_id"), idx_col="pos", n_partitions=8)
out = ml.standard_scale(idx, ["response_time"], F.col("pos") < 800, suffix="_z").toPandas()
print("z", len(out), out.response_time_z.notna().sum())
"""


def test_scale_as_the_first_query_of_a_session(spark):
    n = FX.telemetry(spark, SF0001).count()
    got = subprocess.run([sys.executable, "-c", FRESH, ROOT, SF0001], capture_output=True, text=True, timeout=300)
    assert f"z {n} {n}" in got.stdout, got.stderr[-2000:]


def test_training_rows_are_made_once(spark):
    d = q_models.training_frame(spark, SF0001)
    assert not any("events.parquet" in f for f in d.inputFiles())
    assert d.storageLevel.useMemory and d.storageLevel.useDisk
    assert {r[0] for r in d.select("split").distinct().collect()} == {"train", "val", "test"}
    d.unpersist()


def test_windows_are_made_once(spark, monkeypatch):
    seen, real = [], q_models.rows.ordered_split
    monkeypatch.setattr(q_models.rows, "ordered_split", lambda df, shares: (seen.append(df.inputFiles()), real(df, shares))[1])
    q_models.sequence_frame(spark, SF0001)
    assert seen[0] and not any("events.parquet" in f for f in seen[0])
    assert len({f.rsplit("/", 1)[0] for f in seen[0]}) == 1

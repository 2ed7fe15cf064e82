"""Streamed controls equal the batch machines, also with late rows and a restart between."""

import datetime as dt
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import constants as C
from faultline.operators import stateful
from faultline.session import scratch_dir
from faultline.streaming import controls, ops, ordered

T0 = dt.datetime(2024, 1, 1)
LOG = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("timestamp", T.TimestampType()), T.StructField("backend", T.StringType()), T.StructField("ok", T.BooleanType())])
FIXES = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("timestamp", T.TimestampType()), T.StructField("api_name", T.StringType()),
                      T.StructField("category", T.StringType()), T.StructField("risk", T.DoubleType())])


def log(n=600):
    rng, rows, t = random.Random(4), [], 0.0
    for i in range(n):
        t += rng.choice([0.5, 2.0, 9.0, 20.0])
        rows.append((i, T0 + dt.timedelta(seconds=t), "b" if i % 7 else "c", rng.random() > (0.7 if (i // 40) % 3 == 0 else 0.15)))
    return rows + [(n, T0 + dt.timedelta(days=2), "z", True), (n + 1, T0 + dt.timedelta(days=4), "z", True)]


def arrive(spark, rows, schema, path, files):
    """Rows up to ten minutes late, added as ``files`` files."""
    df = spark.createDataFrame(rows, schema)
    late = F.pmod(F.xxhash64("event_id"), F.lit(600))
    ops.write_in_order(df.withColumn("_at", F.unix_seconds("timestamp") + late), path, "_at", files)


def test_breaker_and_canary_equal_batch_across_a_restart(spark):
    rows = log()
    df = spark.createDataFrame(rows, LOG)
    log_s = df.select("event_id", "backend", (F.unix_micros("timestamp") / 1e6).alias("ts_s"), "ok")
    for start, batch, cols in (
            (controls.stream_breaker, stateful.circuit_breaker(log_s), ["event_id", "backend", "state_before", "allowed", "state_after", "event"]),
            (controls.stream_canary, stateful.canary(log_s.withColumnRenamed("ok", "healthy")), ["event_id", "backend", "route", "canary_stage", "primary_fraction", "event"])):
        path, base = scratch_dir(spark, "ctl"), scratch_dir(spark, "ctl_run")
        with ordered.rocksdb(spark):
            arrive(spark, rows[:301], LOG, path, 3)
            out, _ = ops.run_to_table(start(ops.read_request_stream(spark, path, LOG), delay="15 minutes"), "ctl", base=base)
            first = spark.read.parquet(out).count()
            assert 0 < first < 301
            arrive(spark, rows[301:], LOG, path, 3)  # a new query on the same checkpoint
            ops.run_to_table(start(ops.read_request_stream(spark, path, LOG), delay="15 minutes"), "ctl", base=base)
        got = sorted(map(tuple, spark.read.parquet(out).select(*cols).collect()))
        want = sorted(map(tuple, batch.where(F.col("event_id") < 601).select(*cols).collect()))
        assert got == want and len({g[2:] for g in got}) > 3


def test_decay_ticks_while_no_row_arrives(spark):
    rng, rows = random.Random(1), []
    names = [*(r[0] for r in C.REMEDIES), "other"]
    for i in range(60):
        rows.append((i, T0 + dt.timedelta(minutes=rng.randrange(3000)), rng.choice("xy"), rng.choice(names), rng.random()))
    rows.append((99, T0 + dt.timedelta(days=9), "end", "timeout", 0.5))  # moves the watermark only
    path = scratch_dir(spark, "fix")
    arrive(spark, rows, FIXES, path, 5)
    with ordered.rocksdb(spark):
        out, _ = ops.run_to_table(controls.stream_decay(ops.read_request_stream(spark, path, FIXES), 600, "20 minutes"), "decay")
    want, free = [], {}
    fixes = {r[0]: r[1:] for r in C.REMEDIES}
    for i, ts, api, category, risk in sorted(rows, key=lambda r: (r[1], r[0])):
        action, n, cut = fixes.get(category, fixes["intermittent"])
        if api != "end" and ts >= free.get(api, T0):
            free[api] = ts + dt.timedelta(seconds=600 * n)
            want += [(api, i, action, k, round(max(0.0, risk - k * cut), 9), k >= n) for k in range(1, n + 1)]
    got = [(r.api_name, r.event_id, r.remedy_action, r.ticks, round(r.risk_after, 9), r.fix_complete) for r in spark.read.parquet(out).collect()]
    assert sorted(got) == sorted(want) and len(want) > 40


def test_late_rows_are_kept_apart_across_a_restart(spark):
    rows = [(i, T0 + dt.timedelta(hours=h), "b", True) for i, h in enumerate([0, 10, 9, 1, 30, 29, 27, 2, 31])]
    base, path = scratch_dir(spark, "late_run"), scratch_dir(spark, "late_in")
    for part in (rows[:3], rows[3:6], rows[6:]):  # a run each, on one checkpoint
        ops.write_slices(spark.createDataFrame(part, LOG).withColumn("k", F.lit(0)), path, "k")
        late, timely = ops.split_late(ops.read_request_stream(spark, path, LOG), "late", 3 * 3600, base=base)
    assert sorted(r.event_id for r in spark.read.parquet(late).collect()) == [3, 6, 7]
    assert sorted(r.event_id for r in spark.read.parquet(timely).collect()) == [0, 1, 2, 4, 5, 8]

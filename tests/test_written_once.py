"""Steps that several queries share: computed once, by running sums, in many files."""

import math
import statistics

from pyspark.sql import functions as F

from faultline.operators import features, series
from faultline.plans import q_decisions, q_quality, q_streaming
from faultline.sources import fixtures as FX

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_bucket_by_halving(spark):
    bounds = [1.0, 2.0, 2.0, 5.0, 9.0]
    df = spark.createDataFrame([(x,) for x in (None, 0.0, 1.0, 1.5, 2.0, 2.5, 9.0, 9.5, float("nan"))], "x double")
    got = df.select("x", series._count_below(F.array(*map(F.lit, bounds)), F.col("x"), 9).alias("n")).collect()
    assert [r.n for r in got] == [0, 0, 0, 1, 1, 3, 4, 5, 5]


def test_frames_are_differences_of_running_sums(spark):
    """Nulls, squares whose running sum would overflow a long, and no frame that is summed anew for each row."""
    rts = [None if 70 <= i < 135 or i == 40 else 2e6 + i / 100 for i in range(300)]
    rows = [(i, "market_data_api", rt, 200, None if i % 13 == 5 else i % 3 % 2, None, i % 7, "a") for i, rt in enumerate(rts)]
    df = spark.createDataFrame(rows, "event_id long, api_name string, response_time double, status_code int, success int, error_type string, request_count int, data_source string")
    df = df.withColumn("timestamp", (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins="event_id")).cast("timestamp_ntz"))
    out = features.series_features(df, "batch60", decimals=2, recent_n=20)
    assert "RowFrame, -59" not in plan(out) and "RowFrame, -29" not in plan(out)
    got = {r.event_id: r for r in out.collect()}
    fails = [None if r[4] is None else 1 - r[4] for r in rows]
    for i in range(300):
        assert got[i].recent_failures == sum(x or 0 for x in fails[max(0, i - 20):i])
        seen = [x for x in rts[max(0, i - 59):i + 1] if x is not None]
        if len(seen) > 1 and len(seen) == min(i + 1, 60):
            assert math.isclose(got[i].response_time_rolling_std, statistics.stdev(seen), abs_tol=1e-4)
        if seen and len(seen) == min(i + 1, 60):
            assert math.isclose(got[i].response_time_rolling_mean, statistics.mean(seen), abs_tol=1e-4)
        if not seen:
            assert got[i].response_time_rolling_mean is None
    assert len(got) == 300


def test_audit_and_drift_read_written_features(spark):
    for q in (q_quality.q_audit, q_quality.q_baseline, q_quality.q_oversample, q_quality.q_split):
        assert "events.parquet" not in plan(q(spark, SF)), q.__name__


def test_late_report_in_many_files(spark, monkeypatch):
    one = q_streaming.q_late(spark, SF).collect()
    monkeypatch.setattr(q_streaming, "LATE_FILE_ROWS", 20)
    read, files = q_streaming.ops.read_request_stream, []

    def seen(spark, path, files_per_trigger=1):
        files.extend([files_per_trigger, spark.read.text(path).select(F.input_file_name()).distinct().count()])
        return read(spark, path, files_per_trigger=files_per_trigger)
    monkeypatch.setattr(q_streaming.ops, "read_request_stream", seen)
    assert q_streaming.q_late(spark, SF).collect() == one
    assert files[0] > 1 and files[1] == 2 * files[0]


def test_row_index_sorts_rows_once(spark, monkeypatch):
    """Where buckets begin is told by counts, with null keys and order values as well."""
    plans, real = [], series.reliable_checkpoint
    monkeypatch.setattr(series, "reliable_checkpoint", lambda df: (plans.append(plan(df)), real(df))[1])
    rows = [(i, [None, "a", "b", "a"][i % 4], None if i % 11 == 0 else (i * 37) % 101) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, at int")
    for key, n in (("k", 1), ("k", 7), (None, 16)):
        idx = series.with_row_index(df, key=key, order=("at", "id"), n_partitions=n)
        assert "monotonically_increasing_id" not in plans[-1]
        seen: dict = {}
        for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[0])):
            seen.setdefault(r[1] if key else 0, []).append(r[0])
        want = {i: at for ids in seen.values() for at, i in enumerate(ids)}
        assert {r.id: r.row_idx for r in idx.collect()} == want


def test_healing_takes_one_feature_pass(spark, monkeypatch):
    passes, real = [], features.series_features
    monkeypatch.setattr(features, "series_features", lambda *a, **k: (passes.append(1), real(*a, **k))[1])
    ticks = q_decisions._heal_ticks(spark, SF)
    assert len(passes) == 1 and "events.parquet" not in plan(ticks) and "Aggregate" not in plan(ticks)

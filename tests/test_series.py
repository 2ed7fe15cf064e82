"""Scale-path operators must equal their single-task definitions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from faultline.operators import machines, series, stateful
from faultline.sources import fixtures as FX

from conftest import SF0001


@pytest.fixture(scope="module")
def tele(spark):
    return FX.telemetry(spark, SF0001).cache()


def test_row_index_matches_row_number(spark, tele):
    idx = series.with_row_index(tele, "api_name", ("timestamp", "event_id"), n_partitions=7)
    w = Window.partitionBy("api_name").orderBy("timestamp", "event_id")
    ref = tele.select("event_id", (F.row_number().over(w) - 1).alias("ref"))
    j = idx.join(ref, "event_id")
    assert j.filter(F.col("row_idx") != F.col("ref")).count() == 0
    assert j.count() == tele.count()


def test_blocked_rolling_equals_plain_window(spark, tele):
    idx = series.with_row_index(tele, "api_name", ("timestamp", "event_id"))
    b = series.blocked(idx, block=64, back=59, fwd=5)
    w = series.block_window("api_name")
    got = b.select("event_id", "_home", F.avg("response_time").over(w.rowsBetween(-59, 0)).alias("m"),
                   F.lead("response_time", 5).over(w).alias("l")).filter("_home")
    pw = Window.partitionBy("api_name").orderBy("timestamp", "event_id")
    ref = tele.select("event_id", F.avg("response_time").over(pw.rowsBetween(-59, 0)).alias("rm"),
                      F.lead("response_time", 5).over(pw).alias("rl"))
    j = got.join(ref, "event_id").collect()
    assert len(j) == tele.count()
    for r in j:
        assert r["m"] == pytest.approx(r["rm"], rel=1e-12)
        assert (r["l"] is None and r["rl"] is None) or r["l"] == r["rl"]


@pytest.mark.parametrize("adjust", [True, False])
def test_block_ema_equals_pandas_ewm(spark, tele, adjust):
    idx = series.with_row_index(tele, "api_name", ("timestamp", "event_id"))
    span = 10
    back = series.ema_halo(span)
    b = series.blocked(idx, block=256, back=back)
    w = series.block_window("api_name")
    got = (b.select("api_name", "row_idx", "_home",
                    series.ema_columns(F.col("response_time"), span, w, adjust=adjust).alias("ema"))
           .filter("_home").toPandas().sort_values(["api_name", "row_idx"]))
    pdf = tele.select("api_name", "timestamp", "event_id", "response_time").toPandas()
    pdf = pdf.sort_values(["api_name", "timestamp", "event_id"])
    pdf["ref"] = pdf.groupby("api_name")["response_time"].transform(lambda s: s.ewm(span=span, adjust=adjust).mean())
    assert np.allclose(got["ema"].to_numpy(), pdf["ref"].to_numpy(), rtol=1e-12, atol=1e-10)


def test_cumulative_sum_and_max(spark, tele):
    t = tele.select("api_name", "event_id", F.col("request_count").cast("long").alias("v"))
    cum = series.cumulative(t, "api_name", ["event_id"], ["v"], n_partitions=5)
    w = Window.partitionBy("api_name").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    ref = t.select("event_id", F.sum("v").over(w).alias("r"))
    assert cum.join(ref, "event_id").filter(F.col("cum_v") != F.col("r")).count() == 0
    cmx = series.cumulative(t, "api_name", ["event_id"], ["v"], n_partitions=5, agg="max")
    refm = t.select("event_id", F.max("v").over(w).alias("r"))
    assert cmx.join(refm, "event_id").filter(F.col("cum_v") != F.col("r")).count() == 0


def test_kth_values_exact(spark, tele):
    vals = sorted(r[0] for r in tele.select("response_time").collect())
    ks = [0, 17, len(vals) // 2, len(vals) - 1]
    got = series.kth_values(tele, "response_time", ks)
    for k in ks:
        assert got[k] == vals[k]


def test_chunked_replay_equals_single_chunk(spark, tele):
    log = tele.select("event_id", (F.col("user_id") % 2).cast("string").alias("backend"),
                      (F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6).alias("ts_s"),
                      (F.col("success") == 1).alias("ok"))
    a = stateful.circuit_breaker(log, chunk_rows=37).select("event_id", "state_after", "allowed", "event")
    b = stateful.circuit_breaker(log, chunk_rows=10_000).select("event_id", "state_after", "allowed", "event")
    diff = a.exceptAll(b).count() + b.exceptAll(a).count()
    assert diff == 0
    assert a.count() == log.count()


def _random_log(spark, n=2400):
    import random
    rng, rows, t = random.Random(4), [], 0.0
    for i in range(n):
        t += rng.choice([0.0, 0.5, 2.0, 9.0, 20.0])
        bad = (i // 40) % 3 == 0
        rows.append((i, "b" if i % 7 else "c", t, rng.random() > (0.7 if bad else 0.15)))
    return spark.createDataFrame(rows, "event_id long, backend string, ts_s double, ok boolean")


def _breaker_by_hand(rows, fails=3, probe=15.0):
    state, streak, opened, out = "CLOSED", 0, 0.0, []
    for ts, ok in rows:
        before, passes = state, state == "CLOSED" or ts - opened >= probe
        if passes and ok:
            state, streak = "CLOSED", 0
        elif passes:
            streak += 1
            if before == "OPEN" or streak >= fails:
                state, opened = "OPEN", ts
        out.append((before, passes, state))
    return out


def _canary_by_hand(polls, hold=10.0):
    share = [0.10, 0.50, 1.00]
    stage, since, out = None, 0.0, []
    for i, (ts, up) in enumerate(polls):
        if i and polls[i - 1][1] == up:
            if stage is None and not up:
                stage = 0
            elif up and stage == 0:
                stage, since = 1, ts
            elif up and stage and ts - since >= hold:
                stage, since = (stage + 1 if stage + 1 < 3 else None), ts
        out.append((stage or 0, 1.0 if stage is None else share[stage - 1] if stage else 0.0))
    return out


@pytest.mark.parametrize("chunk,fan", [(4, 512), (3, 5), (100_000, 512)])
def test_machines_are_exact_over_many_chunks(spark, monkeypatch, chunk, fan):
    monkeypatch.setattr(machines, "FAN", fan)
    log = _random_log(spark)
    rows = {k: [(r.ts_s, r.ok) for r in sorted(log.where(F.col("backend") == k).collect(), key=lambda r: r.event_id)] for k in "bc"}
    got = stateful.circuit_breaker(log, chunk_rows=chunk).orderBy("event_id").collect()
    up = stateful.canary(log.withColumnRenamed("ok", "healthy"), chunk_rows=chunk).orderBy("event_id").collect()
    for k in "bc":
        assert [(r.state_before, r.allowed, r.state_after) for r in got if r.backend == k] == _breaker_by_hand(rows[k])
        assert [(r.canary_stage, r.primary_fraction) for r in up if r.backend == k] == _canary_by_hand(rows[k])
    assert len(got) == len(up) == 2400


def test_route_over_many_chunks_equals_one(spark):
    import random
    rng = random.Random(6)
    rows = [("s", i, {r: rng.random() for r in "abc" if rng.random() > 0.05}) for i in range(1500)]
    df = spark.createDataFrame(rows, "session string, tick int, risks map<string,double>")
    one, many = (sorted(map(str, stateful.route(df, "session", "tick", "risks", list("abc"), "a", chunk_rows=c).drop("risks").collect())) for c in (5000, 2))
    assert one == many and len(one) == 1500

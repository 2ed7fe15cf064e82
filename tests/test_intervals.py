import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from faultline.operators import intervals

T0 = dt.datetime(2024, 1, 1)


def test_hundred_thousand_overlapping_entries(spark):
    n = 100_000
    cal = spark.range(n).select(
        F.col("id").alias("seq"), (F.pmod(F.xxhash64("id"), F.lit(1_000_000))).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(200_000)).alias("len"))
    cal = cal.select("seq", "a", (F.col("a") + F.col("len")).alias("b")).withColumn("start", F.timestamp_seconds(F.col("a"))).withColumn("end", F.timestamp_seconds(F.col("b")))
    rows = spark.range(3000).select("id", F.timestamp_seconds(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1_300_000))).alias("timestamp"))
    out = intervals.last_match(rows, cal, ["seq", "a", "b"])
    e = np.array([(r.a, r.b) for r in cal.orderBy("seq").select("a", "b").collect()])
    got = out.select("id", F.unix_seconds("timestamp").alias("t"), "_event").collect()
    assert len(got) == 3000
    held = 0
    for r in got:
        hit = np.flatnonzero((e[:, 0] <= r.t) & (r.t <= e[:, 1]))
        assert (r._event.seq if r._event else None) == (int(hit[-1]) if len(hit) else None)
        held += len(hit)
    assert held > 10_000_000 and any(r._event is None for r in got)  # far more matches than rows ever made


def test_edges_keys_nulls_and_empty_calendar(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    cal = spark.createDataFrame([
        (1, None, at(1), at(5), "all", .2, 2.0), (2, "x", at(3), at(3), "point", .1, 3.0), (3, "x", at(9), at(8), "never", .9, 9.0), (4, None, at(4), at(6), "later", .1, 1.5),
        (5, "y", None, at(9), "open", .9, 9.0), (6, "y", at(5), at(6), "normal", .7, 1.0)],
        "seq int, api_name string, start timestamp, end timestamp, event_label string, error_rate_boost double, rt_multiplier double")
    rows = [(i, api, at(h) if h is not None else None) for i, (api, h) in enumerate([("x", 0), ("x", 1), ("x", 3), ("y", 3), ("x", 5), ("y", 6), ("x", 6.01), (None, 4), ("x", None), ("x", 3)])]
    df = spark.createDataFrame(rows, "i int, api_name string, timestamp timestamp")
    got = {r.i: (r.event_label, r.error_rate_boost, r.rt_multiplier) for r in intervals.tag_from_calendar(df, cal).collect()}
    none = ("normal", 0.0, 1.0)
    assert got == {0: none, 1: ("all", .2, 2.0), 2: ("point", .2, 3.0), 3: ("all", .2, 2.0), 4: ("later", .1, 1.5), 5: ("later", .7, 1.5), 6: none,
                   7: ("later", .1, 1.5), 8: none, 9: ("point", .2, 3.0)}
    assert {r.event_label for r in intervals.tag_from_calendar(df, cal.limit(0)).collect()} == {"normal"}

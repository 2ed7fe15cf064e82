"""Registered queries: Structured Streaming jobs (STR-*) run to completion
(availableNow) over a file stream of the request log derived from ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import constants as C
from faultline.plans import q_decisions as D
from faultline.plans.catalog import ORACLES, register
from faultline.session import scratch_dir
from faultline.sources import fixtures as FX
from faultline.streaming import ops

T_ = "WITH " + FX.telemetry_sql() + "\n"


def _stream(spark, sf):
    path = ops.write_request_log(FX.telemetry(spark, sf))
    return ops.read_request_stream(spark, path)


@register("str_error_windows_1min", T_ + """
SELECT date_trunc('minute', "timestamp") AS window_start, date_trunc('minute', "timestamp") + INTERVAL 1 MINUTE AS window_end,
       api_name, count(*) AS requests, sum(1 - success) AS failures, sum(1 - success) / count(*) AS error_rate
FROM telemetry GROUP BY 1, 2, 3""")
def q_windows(spark, sf):
    out, _ = ops.run_to_table(ops.error_windows(_stream(spark, sf), "1 minute", watermark="1 hour"),
                              "err_windows", "update")
    t = ops.latest_per_key(spark.read.parquet(out), ["window_start", "api_name"])
    return t.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")) \
        .withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@register("str_sliding_60min", T_ + """, w AS (
  SELECT t.*, time_bucket(INTERVAL 15 MINUTE, "timestamp") - (o.k * INTERVAL 15 MINUTE) AS window_start
  FROM telemetry t, (VALUES (0), (1), (2), (3)) o(k))
SELECT window_start, window_start + INTERVAL 60 MINUTE AS window_end, api_name, count(*) AS requests,
       sum(1 - success) AS failures, sum(1 - success) / count(*) AS error_rate
FROM w GROUP BY 1, 2, 3""")
def q_sliding(spark, sf):
    out, _ = ops.run_to_table(ops.error_windows(_stream(spark, sf), "60 minutes", "15 minutes", "2 hours"),
                              "sliding", "update")
    t = ops.latest_per_key(spark.read.parquet(out), ["window_start", "api_name"])
    return t.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")) \
        .withColumn("window_end", F.col("window_end").cast("timestamp_ntz"))


@register("str_failure_bursts", T_ + """, f AS (SELECT api_name, "timestamp" FROM telemetry WHERE success = 0),
g AS (SELECT *, CASE WHEN lag("timestamp") OVER w IS NULL OR "timestamp" - lag("timestamp") OVER w >= INTERVAL 10 MINUTE
                     THEN 1 ELSE 0 END AS brk FROM f WINDOW w AS (PARTITION BY api_name ORDER BY "timestamp")),
s AS (SELECT *, sum(brk) OVER (PARTITION BY api_name ORDER BY "timestamp" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g)
SELECT min("timestamp") AS burst_start, max("timestamp") + INTERVAL 10 MINUTE AS burst_end, api_name, count(*) AS failures
FROM s GROUP BY api_name, sid""")
def q_bursts(spark, sf):
    # session windows support append (production: closes on the watermark) and
    # complete; the bounded fixture uses complete and keeps the last batch
    out, _ = ops.run_to_table(ops.failure_bursts(_stream(spark, sf), "10 minutes", "40 days"), "bursts", "complete")
    t = spark.read.parquet(out)
    t = t.filter(F.col("batch_id") == t.select(F.max("batch_id")).scalar()).drop("batch_id")
    return t.withColumn("burst_start", F.col("burst_start").cast("timestamp_ntz")) \
        .withColumn("burst_end", F.col("burst_end").cast("timestamp_ntz"))


@register("str_dedup_transfers", "WITH " + FX.ledger_sql() + """
SELECT DISTINCT idempotency_key, txn_id FROM transfers""")
def q_dedup(spark, sf):
    tr = FX.transfers(spark, sf).select("idempotency_key", "txn_id", "created_at", "region")
    path = ops.write_request_log(tr, n_files=4, ts="created_at")
    schema = T.StructType([T.StructField("idempotency_key", T.StringType()), T.StructField("txn_id", T.LongType()),
                           T.StructField("created_at", T.TimestampType()), T.StructField("region", T.StringType())])
    s = ops.read_request_stream(spark, path, schema)
    out, _ = ops.run_to_table(ops.dedup(s, "idempotency_key", "created_at", "2 days").select("idempotency_key",
                                                                                           "txn_id"), "dedup")
    return spark.read.parquet(out).drop("batch_id")


ONLINE_COLS = ["event_id", "api_name", "rt_mean", "rt_std", "err_rate", "err_vol", "lag1_rt", "lag5_rt",
               "ema10_slice", "latency_slope", "latency_spike", "error_burst", "n_seen", "scored", "risk"]
A10 = 2 / (10 + 1)


@register("str_online_features", T_ + f""", t0 AS (
  SELECT *, row_number() OVER (PARTITION BY api_name ORDER BY "timestamp", event_id) AS n_seen FROM telemetry),
w AS (
  SELECT event_id, api_name, response_time AS rt, CAST(1 - success AS DOUBLE) AS err, n_seen,
         list(response_time) OVER f AS sl,
         avg(response_time) OVER f AS rt_mean, coalesce(stddev_pop(response_time) OVER f, 0.0) AS rt_std,
         avg(CAST(1 - success AS DOUBLE)) OVER f AS err_rate,
         coalesce(stddev_pop(CAST(1 - success AS DOUBLE)) OVER f, 0.0) AS err_vol,
         coalesce(lag(response_time, 1) OVER o, response_time) AS lag1_rt,
         coalesce(lag(response_time, 5) OVER o, response_time) AS lag5_rt,
         CASE WHEN count(*) OVER f < 2 THEN 0.0
              ELSE coalesce(regr_slope(response_time, CAST(n_seen AS DOUBLE)) OVER f, 0.0) END AS latency_slope
  FROM t0
  WINDOW o AS (PARTITION BY api_name ORDER BY "timestamp", event_id),
         f AS (PARTITION BY api_name ORDER BY "timestamp", event_id ROWS BETWEEN {ops.ONLINE_N - 1} PRECEDING AND CURRENT ROW))
SELECT event_id, api_name, rt_mean, rt_std, err_rate, err_vol, lag1_rt, lag5_rt,
       list_reduce(sl, lambda acc, x: {A10!r} * x + {1 - A10!r} * acc) AS ema10_slice,
       latency_slope,
       CASE WHEN rt_std > 0 AND rt > rt_mean + 2 * rt_std THEN 1.0 ELSE 0.0 END AS latency_spike,
       CASE WHEN err_rate > 0.5 THEN 1.0 ELSE 0.0 END AS error_burst,
       n_seen, n_seen % {C.SCORE_EVERY} = 0 AS scored,
       CASE WHEN n_seen % {C.SCORE_EVERY} = 0 THEN least(1.0, 3 * err_rate + 2 * greatest(0.0, rt_mean / 1000.0 - 0.5)) END AS risk
FROM w""")
def q_online(spark, sf):
    out, _ = ops.run_to_table(ops.stream_features(_stream(spark, sf)), "online")
    return spark.read.parquet(out).select(*ONLINE_COLS)


def _reordered_sql(hours: int) -> str:
    """All online columns by windows over the sorted log, up to the last watermark."""
    flags = lambda k: "CASE api_name " + " ".join(f"WHEN '{a}' THEN {v[k]!r}" for a, v in C.ONLINE_FLAGS.items()) + " END::DOUBLE"
    ema = lambda xs, span: f"list_reduce({xs}, lambda a, x: {2 / (span + 1)!r} * x + {1 - 2 / (span + 1)!r} * a)"
    base = "CASE WHEN rt_mean > 0 THEN rt_mean ELSE 0.3 END"
    days = ", ".join(f"{100 * m + d}" for m, d in C.ONLINE_HOLIDAYS)
    f = {
        "response_time": "rt", "request_count": "n_seen", "hour": "h", "day_of_week": "d", "is_market_hours": "h >= 9 AND h < 17",
        "is_financial_peak": "h IN (9, 14)", "is_weekend": "d >= 5", "is_holiday": f"100 * month(t) + day(t) IN ({days})", "response_time_rolling_mean": "rt_mean",
        "response_time_rolling_std": "rt_std", "error_rate_rolling": "er", "response_time_variance": "rt_std * rt_std", "error_volatility": "ev",
        "response_time_lag_1": "lag1", "response_time_lag_5": "lag5", "error_rate_lag_1": "e1", "response_time_ema_10": ema("sl", 10),
        "response_time_ema_30": ema("sl", 30), "error_rate_ema_10": ema("el", 10), "hour_sin": "sin(2 * pi() * h / 24)", "hour_cos": "cos(2 * pi() * h / 24)",
        "dow_sin": "sin(2 * pi() * d / 7)", "dow_cos": "cos(2 * pi() * d / 7)", "high_frequency_api": flags(0), "api_complexity": flags(1),
        "error_rate_boost": "greatest(0.0, er - 0.05)", "rt_multiplier": f"rt / {base}", "latency_diff_1": "rt - lag1", "latency_diff_5": "rt - lag5",
        "error_rate_diff_1": "e1 - e2", "error_rate_diff_5": "CASE WHEN e6 = 0 THEN e1 ELSE 0 END", "latency_spike": "rt_std > 0 AND rt > rt_mean + 2 * rt_std",
        "error_burst": "er > 0.5", "instability_index": f"least(1.0, rt_std / ({base}) + ev)", "latency_slope": "lat_slope", "error_slope": "err_slope",
        "traffic_change": "((m - greatest(1, m // 2)) - greatest(1, m // 2)) / greatest(1, m // 2)", "burst_ratio": "(m - greatest(1, m // 2)) / greatest(1, m // 2)"}
    cols = ", ".join(f"CASE WHEN n_seen >= {C.ONLINE_MIN_RECORDS} THEN ({f.get(c, '0')})::DOUBLE END AS {c}" for c in C.FEATURE_COLS)
    health = ", ".join(f"avg_rt_{n}, p95_{n}[CAST(floor(len(p95_{n}) * 0.95::DOUBLE) AS INT) + 1] AS p95_rt_{n}, error_rate_{n}, "
                       f"CASE WHEN error_rate_{n} > 0.3 THEN 'unhealthy' ELSE 'healthy' END AS status_{n}" for n in C.HEALTH_WINDOWS)
    over = ", ".join(f"fsum(rt) OVER f{n} / count(*) OVER f{n} AS avg_rt_{n}, list_sort(list(rt) OVER f{n}) AS p95_{n}, avg(err) OVER f{n} AS error_rate_{n}" for n in C.HEALTH_WINDOWS)
    frames = ", ".join(f"f{n} AS (PARTITION BY api_name ORDER BY t, event_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in C.HEALTH_WINDOWS)
    return T_ + f""", s AS (
  SELECT event_id, api_name, "timestamp" AS t, response_time AS rt, CAST(1 - success AS DOUBLE) AS err, CAST(hour("timestamp") AS DOUBLE) AS h,
         CAST(isodow("timestamp") - 1 AS DOUBLE) AS d, row_number() OVER (PARTITION BY api_name ORDER BY "timestamp", event_id) AS n_seen FROM telemetry),
w AS (
  SELECT *, list(rt) OVER f AS sl, list(err) OVER f AS el, count(*) OVER f AS m, list(rt) OVER u AS hist, list(err) OVER u AS ehist,
    avg(rt) OVER f AS rt_mean, coalesce(stddev_pop(rt) OVER f, 0) AS rt_std, avg(err) OVER f AS er, coalesce(stddev_pop(err) OVER f, 0) AS ev,
    coalesce(lag(rt, 1) OVER o, rt) AS lag1, coalesce(lag(rt, 5) OVER o, rt) AS lag5, coalesce(lag(err, 1) OVER o, err) AS e1,
    coalesce(lag(err, 2) OVER o, 0) AS e2, lag(err, 6) OVER o AS e6, regr_slope(rt, CAST(n_seen AS DOUBLE)) OVER f AS lat_slope,
    regr_slope(err, CAST(n_seen AS DOUBLE)) OVER f AS err_slope, {over}
  FROM s WINDOW o AS (PARTITION BY api_name ORDER BY t, event_id), u AS (PARTITION BY api_name ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    f AS (PARTITION BY api_name ORDER BY t, event_id ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), {frames})
SELECT event_id, api_name, t AS "timestamp", n_seen, {cols}, {ema("[0.0::DOUBLE] || hist", 10)} AS ema10_running, {ema("[0.0::DOUBLE] || hist", 30)} AS ema30_running,
  {ema("[0.0::DOUBLE] || ehist", 10)} AS err_ema10_running, {health}
FROM w WHERE epoch_ms(t) < (SELECT max(epoch_ms("timestamp")) FROM telemetry) - {hours * 3_600_000}"""


def _late_log(t, hours: int = 5, n_files: int = 6) -> str:
    """The rows as files in order of arrival, each up to ``hours`` after its time."""
    path = scratch_dir(t.sparkSession, "late_log")
    t = t.withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    late = F.pmod(F.xxhash64("event_id"), F.lit(hours * 3600))
    ops.write_in_order(t.withColumn("_at", F.unix_seconds("timestamp") + late), path, "_at", n_files)
    return path


@register("str_online_reordered", _reordered_sql(6))
def q_online_reordered(spark, sf):
    """Requests arrive up to five hours late, over several micro-batches; the
    watermark waits six."""
    from faultline.streaming import online, ordered
    path = _late_log(FX.telemetry(spark, sf))
    with ordered.rocksdb(spark):
        out, _ = ops.run_to_table(online.online_features(ops.read_request_stream(spark, path), "6 hours"), "reordered")
    return spark.read.parquet(out).drop("batch_id").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


BEHIND = '(SELECT max(epoch_ms("timestamp")) FROM telemetry) - 6 * 3600000'


def _controls(spark, sf, start, columns: str):
    """A control over the request log, which arrives up to five hours late."""
    from faultline.streaming import ordered
    t = FX.telemetry(spark, sf).select("event_id", "timestamp", (F.col("user_id") % 3).cast("string").alias("backend"), (F.col("success") == 1).alias("ok"))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("timestamp", T.TimestampType()),
                           T.StructField("backend", T.StringType()), T.StructField("ok", T.BooleanType())])
    with ordered.rocksdb(spark):
        out, _ = ops.run_to_table(start(ops.read_request_stream(spark, _late_log(t), schema), delay="6 hours"), "controls")
    return spark.read.parquet(out).withColumn("ts_s", F.col("ts_us") / F.lit(1e6)).selectExpr(*columns.split(", "))


@register("str_breaker_stream", ORACLES["dec_circuit_breaker"] + f" AND ts_s * 1000 < {BEHIND}")
def q_breaker_stream(spark, sf):
    from faultline.streaming import controls
    return _controls(spark, sf, controls.stream_breaker, "event_id, backend, ts_s, ok, state_before, allowed, state_after, event")


@register("str_canary_stream", ORACLES["dec_canary"] + f" AND ts_s * 1000 < {BEHIND}")
def q_canary_stream(spark, sf):
    from faultline.streaming import controls
    return _controls(spark, sf, controls.stream_canary, "event_id, backend, ts_s, ok AS healthy, route, canary_stage, primary_fraction, event")


TICK_S = 3600


@register("str_decay_stream", "WITH RECURSIVE " + FX.telemetry_sql() + f""",
fx AS MATERIALIZED (SELECT event_id, api_name, epoch_us("timestamp") AS us, [{", ".join(f"'{r[0]}'" for r in C.REMEDIES)}, 'other'][1 + event_id % {len(C.REMEDIES) + 1}] AS category,
       least(1.0, response_time / 500) AS risk FROM telemetry WHERE success = 0),
rm(category, action, n, cut) AS (VALUES {", ".join(f"('{r[0]}', '{r[1]}', {r[2]}, {r[3]!r}::DOUBLE)" for r in C.REMEDIES)}),
ln AS MATERIALIZED (SELECT fx.* EXCLUDE (category), rm.action, rm.n, rm.cut FROM fx JOIN rm ON rm.category = CASE WHEN fx.category = 'other' THEN 'intermittent' ELSE fx.category END),
r(api_name, us, event_id, risk, action, n, cut) AS (
  SELECT * FROM (SELECT api_name, us, event_id, risk, action, n, cut FROM ln QUALIFY row_number() OVER (PARTITION BY api_name ORDER BY us, event_id) = 1)
  UNION ALL
  SELECT * FROM (SELECT l.api_name, l.us, l.event_id, l.risk, l.action, l.n, l.cut FROM r JOIN ln l ON l.api_name = r.api_name AND l.us >= r.us + r.n * {TICK_S * 10**6}
                 QUALIFY row_number() OVER (PARTITION BY l.api_name ORDER BY l.us, l.event_id) = 1))
SELECT api_name, event_id, make_timestamp(us + k * {TICK_S * 10**6}) AS tick, action AS remedy_action, k AS ticks, greatest(0.0, risk - k * cut) AS risk_after, k >= n AS fix_complete
FROM r, range(1, 9) t(k) WHERE k <= n AND us + k * {TICK_S * 10**6} < 1000 * ((SELECT max(us) // 1000 FROM fx) - 6 * 3600000)""")
def q_decay_stream(spark, sf):
    from faultline.streaming import controls, ordered
    names = F.array(*[F.lit(r[0]) for r in C.REMEDIES], F.lit("other"))
    t = FX.telemetry(spark, sf).where("success = 0").select(
        "event_id", "timestamp", "api_name", F.element_at(names, (F.col("event_id") % (len(C.REMEDIES) + 1) + 1).cast("int")).alias("category"),
        F.least(F.lit(1.0), F.col("response_time") / 500).alias("risk"))
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("timestamp", T.TimestampType()), T.StructField("api_name", T.StringType()),
                           T.StructField("category", T.StringType()), T.StructField("risk", T.DoubleType())])
    with ordered.rocksdb(spark):
        out, _ = ops.run_to_table(controls.stream_decay(ops.read_request_stream(spark, _late_log(t), schema), TICK_S, "6 hours"), "decay")
    return spark.read.parquet(out).select("api_name", "event_id", F.timestamp_micros("tick_us").cast("timestamp_ntz").alias("tick"),
                                          "remedy_action", "ticks", "risk_after", "fix_complete")


@register("str_route_stream", D.route_sql_as("api_name, ts_bucket AS tick, 'region-' || a AS active, state, action LIKE 'hold_alert%' AS alert, action"))
def q_route_stream(spark, sf):
    from faultline.plans.q_decisions import _route_input
    ticks = _route_input(spark, sf).withColumnRenamed("ts_bucket", "tick")
    path = scratch_dir(spark, "ticks")
    ops.write_in_order(ticks.withColumn("tick", F.col("tick").cast("timestamp")).withColumn("_at", F.col("tick")), path, "_at", 4)
    schema = T.StructType([T.StructField("api_name", T.StringType()), T.StructField("tick", T.TimestampType()),
                           T.StructField("risks", T.MapType(T.StringType(), T.DoubleType()))])
    s = ops.read_request_stream(spark, path, schema)
    out, _ = ops.run_to_table(ops.stream_route(s, ["region-0", "region-1", "region-2"], "region-0", 0.55, 0.35, 3),
                              "route_stream")
    return spark.read.parquet(out).drop("batch_id").withColumn("tick", F.col("tick").cast("timestamp_ntz"))


LATE_FILE_ROWS = 10_000  # rows of the newest slice for each file it is written in


@register("str_late_data_report")
def q_late(spark, sf):
    """STR-09: replay the log with files out of time order and a tight
    watermark; report rows the watermark dropped."""
    t = FX.telemetry(spark, sf)
    path = scratch_dir(spark, "late_log")
    # newest slice first, then the rest: the first batch pushes the watermark past older rows
    recent = t.filter(F.col("timestamp") >= t.select(F.percentile_approx(F.col("timestamp"), 0.9)).scalar())
    older = t.join(recent.select("event_id"), "event_id", "left_anti")
    cols = [f.name for f in ops.REQUEST_SCHEMA.fields]
    # both in as many files, none of them empty as every task deals its rows out in turn: a batch reads all of one
    files = max(1, min(recent.count() // LATE_FILE_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    for part in (recent, older):
        part.select(*cols).repartition(files).write.mode("append").option("timestampFormat", ops.TS_FORMAT).json(path)
    s = ops.read_request_stream(spark, path, files_per_trigger=files)
    _, progress = ops.run_to_table(ops.error_windows(s, "1 minute", watermark="10 minutes"), "late", "update")
    rep = ops.late_report(progress)
    return spark.createDataFrame([(rep["batches"], rep["rows_dropped_by_watermark"], rep["max_state_rows"])],
                                 "batches int, rows_dropped_by_watermark long, max_state_rows long")


@register("str_late_rows", T_ + """,
s AS (SELECT event_id, "timestamp" AS t, event_id % 7 AS k FROM telemetry),
m AS (SELECT k, max(t) AS top FROM s GROUP BY 1),
w AS (SELECT a.k, date_trunc('milliseconds', max(b.top)) - INTERVAL 14 DAY AS mark FROM m a JOIN m b ON b.k < a.k GROUP BY 1)
SELECT event_id, coalesce(t <= mark, false) AS late FROM s LEFT JOIN w USING (k)""")
def q_late_rows(spark, sf):
    """STR-09: the log in seven batches, each over the whole month; what is more
    than 14 days behind the batches before goes to the table of late rows."""
    t = FX.telemetry(spark, sf).withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn("_k", F.col("event_id") % 7)
    path = scratch_dir(spark, "batches")
    ops.write_slices(t, path, "_k")
    late, timely = ops.split_late(ops.read_request_stream(spark, path), "split", 14 * 86400)
    both = spark.read.parquet(late).withColumn("late", F.lit(True)).unionByName(spark.read.parquet(timely).withColumn("late", F.lit(False)))
    return both.select("event_id", "late")

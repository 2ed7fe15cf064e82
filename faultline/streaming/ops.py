"""Structured Streaming operators (STR-01..10, SRC-09, SNK-06).

Every stream reads files (the request log) with a fixed schema, keeps state
per key in Spark's state store (watermarked aggregations, dedup, or
``applyInPandasWithState`` with a bounded per-key ring buffer), and writes an
append-only table through ``foreachBatch`` (batch id recorded, so the final
view of an update-mode aggregate is "latest version per key").  Checkpoints
live under the shared checkpoint folder, so a restarted query resumes
exactly-once.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from faultline import constants as C
from faultline.operators import stateful
from faultline.session import scratch_dir

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"   # keep microseconds through JSON
REQUEST_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("timestamp", T.TimestampType()),
    T.StructField("api_name", T.StringType()), T.StructField("response_time", T.DoubleType()),
    T.StructField("success", T.IntegerType()), T.StructField("status_code", T.IntegerType()),
    T.StructField("request_count", T.IntegerType()), T.StructField("user_id", T.LongType()),
])


def write_in_order(df: DataFrame, path: str, order: str, n_files: int) -> None:
    """``df`` without ``order`` as JSON files, a slice of ``order`` each, written one
    after another, as the file source reads files by age.  One range-partitioned pass
    cuts the slices; each is then read from its own file alone."""
    spark, stage = df.sparkSession, scratch_dir(df.sparkSession, "slices")
    cut = df.repartitionByRange(n_files, order).withColumn("_slice", F.spark_partition_id())
    cut.sortWithinPartitions(order).write.partitionBy("_slice").parquet(stage)
    for (k,) in sorted(cut_ids(spark, stage)):
        (spark.read.schema(df.schema).parquet(f"{stage}/_slice={k}").drop(order)
         .write.mode("append").option("timestampFormat", TS_FORMAT).json(path))


def write_slices(df: DataFrame, path: str, slice_col: str) -> None:
    """``df`` without ``slice_col`` as one JSON file for each of its values, in their order."""
    spark, stage = df.sparkSession, scratch_dir(df.sparkSession, "slices")
    df.withColumnRenamed(slice_col, "_slice").repartition("_slice").write.partitionBy("_slice").parquet(stage)
    schema = df.drop(slice_col).schema
    for (k,) in sorted(cut_ids(spark, stage)):
        (spark.read.schema(schema).parquet(f"{stage}/_slice={k}").write.mode("append").option("timestampFormat", TS_FORMAT).json(path))


def cut_ids(spark: SparkSession, stage: str) -> list:
    return spark.read.parquet(stage).select("_slice").distinct().collect()


def write_request_log(df: DataFrame, n_files: int = 8, ts: str = "timestamp") -> str:
    """Materialise a request log as JSON files in event-time order: the stream's input folder."""
    path = scratch_dir(df.sparkSession, "request_log")
    d = df.withColumn(ts, F.col(ts).cast("timestamp"))
    write_in_order(d.withColumn("_at", F.unix_micros(ts)), path, "_at", n_files)
    return path


def read_request_stream(spark: SparkSession, path: str, schema: T.StructType = REQUEST_SCHEMA,
                        files_per_trigger: int = 1) -> DataFrame:
    """SRC-09: the request log as a stream (one file per micro-batch)."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .option("timestampFormat", TS_FORMAT).json(path))


def run_to_table(sdf: DataFrame, name: str, output_mode: str = "append", base: str | None = None) -> tuple[str, list]:
    """SNK-06: run to completion (availableNow) and keep every micro-batch in a
    folder of its own, ``batch_id=N``, that a retried batch replaces.  With the
    same ``base`` folder a later call resumes after the last finished batch.
    Returns (path, progress of all batches)."""
    spark = sdf.sparkSession
    base = base or scratch_dir(spark, name)
    out, ckpt, every = f"{base}/out", f"{base}/checkpoint", "spark.sql.streaming.numRecentProgressUpdates"

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    before = spark.conf.get(every, "100")
    spark.conf.set(every, str(2**31 - 1))  # else only the last 100 batches report
    try:
        q = (sdf.writeStream.outputMode(output_mode).foreachBatch(sink)
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
        return out, list(q.recentProgress)
    finally:
        spark.conf.set(every, before)


def latest_per_key(table: DataFrame, keys) -> DataFrame:
    """Final state of an update-mode result: the row of the highest batch per key."""
    w = Window.partitionBy(*keys).orderBy(F.col("batch_id").desc())
    return table.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "batch_id")


# --- STR-07 / STR-08 windows ------------------------------------------------------------------------
def error_windows(stream: DataFrame, width: str = "1 minute", slide: str | None = None,
                  watermark: str = "10 minutes") -> DataFrame:
    """STR-07 (tumbling) / STR-08 (sliding when ``slide``): per-(window, api)
    requests, failures and error rate, event-time with a watermark."""
    w = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    return (stream.withWatermark("timestamp", watermark).groupBy(w.alias("w"), "api_name")
            .agg(F.count(F.lit(1)).alias("requests"), F.sum(F.lit(1) - F.col("success")).alias("failures"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "api_name",
                    "requests", "failures", (F.col("failures") / F.col("requests")).alias("error_rate")))


def failure_bursts(stream: DataFrame, gap: str = "10 minutes", watermark: str = "30 minutes") -> DataFrame:
    """STR-08: session windows over failures — bursts separated by ``gap``."""
    f = stream.filter(F.col("success") == 0).withWatermark("timestamp", watermark)
    s = F.session_window("timestamp", gap)
    return (f.groupBy(s.alias("s"), "api_name").agg(F.count(F.lit(1)).alias("failures"))
            .select(F.col("s.start").alias("burst_start"), F.col("s.end").alias("burst_end"), "api_name",
                    "failures"))


def dedup(stream: DataFrame, key: str = "idempotency_key", ts: str = "created_at",
          delay: str = "1 hour") -> DataFrame:
    """STR-06: idempotent request dedup within the watermark delay."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def late_report(progress: list) -> dict:
    """STR-09: rows dropped by the watermark (and state rows) over a run."""
    dropped, state_rows = 0, 0
    for p in progress:
        for op in p.stateOperators or []:
            dropped += op.numRowsDroppedByWatermark or 0
            state_rows = max(state_rows, op.numRowsTotal or 0)
    return {"batches": len(progress), "rows_dropped_by_watermark": dropped, "max_state_rows": state_rows}


def split_late(stream: DataFrame, name: str, delay_s: float, ts: str = "timestamp", base: str | None = None) -> tuple[str, str]:
    """STR-09 side output: rows of a micro-batch at or behind the watermark of the
    batches before it (greatest time seen less ``delay_s``, as the engine's own) go to
    a table of late rows, the others to a table of rows on time; every row is in one of
    the two.  Each batch leaves its greatest time beside its rows, so a retried batch
    or a restart (same ``base``) splits as before.  Returns the two paths."""
    spark = stream.sparkSession
    base = base or scratch_dir(spark, name)
    late, timely, seen = f"{base}/late", f"{base}/on-time", f"{base}/seen"
    spark.createDataFrame([], "us long").write.mode("append").parquet(f"{seen}/batch_id=-1")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        before = spark.read.schema("us long, batch_id long").parquet(seen).where(F.col("batch_id") < batch_id).agg(F.max("us")).first()[0]
        mark = None if before is None else before // 1000 * 1000 - int(delay_s * 1e6)  # watermarks count milliseconds
        behind = F.lit(False) if mark is None else F.coalesce(F.unix_micros(ts) <= mark, F.lit(False))
        batch.where(behind).write.mode("overwrite").parquet(f"{late}/batch_id={batch_id}")
        batch.where(~behind).write.mode("overwrite").parquet(f"{timely}/batch_id={batch_id}")
        batch.agg(F.max(F.unix_micros(ts)).alias("us")).write.mode("overwrite").parquet(f"{seen}/batch_id={batch_id}")
        batch.unpersist()

    (stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()).awaitTermination()
    return late, timely


# --- STR-01..04 keyed ring-buffer features --------------------------------------------------------------
BUFFER = 250
ONLINE_N = 21
FEATURE_OUT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("api_name", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("rt_mean", T.DoubleType()), T.StructField("rt_std", T.DoubleType()),
    T.StructField("err_rate", T.DoubleType()), T.StructField("err_vol", T.DoubleType()),
    T.StructField("lag1_rt", T.DoubleType()), T.StructField("lag5_rt", T.DoubleType()),
    T.StructField("ema10_slice", T.DoubleType()), T.StructField("latency_slope", T.DoubleType()),
    T.StructField("latency_spike", T.DoubleType()), T.StructField("error_burst", T.DoubleType()),
    T.StructField("ema10_running", T.DoubleType()), T.StructField("n_seen", T.LongType()),
    T.StructField("scored", T.BooleanType()), T.StructField("risk", T.DoubleType()),
])
STATE = T.StructType([T.StructField("buf", T.StringType())])


def online_rows(rt: np.ndarray, ok: np.ndarray, st: dict, n: int = ONLINE_N, every: int = C.SCORE_EVERY) -> tuple[pd.DataFrame, dict]:
    """Online features of new records of one key, given its state, all rows at
    once: statistics over the last ``n`` records (population std, lags filled with
    the current value, EMA seeded with the window's first value, OLS slope), a
    zero-seeded running EMA (STR-03) and a fallback risk every ``every`` records
    (STR-04)."""
    old = np.array(st.get("buf", []), dtype=float).reshape(-1, 2)
    new, k = np.column_stack([rt, ok]).astype(float), len(old)
    both = np.concatenate([np.full((n - 1, 2), np.nan), old, new])
    win = np.lib.stride_tricks.sliding_window_view(both, n, axis=0)[k:]
    v, err = win[:, 0, :], 1.0 - win[:, 1, :]
    have = ~np.isnan(v)
    size = have.sum(axis=1)

    def moments(x):
        mean = np.where(have, x, 0.0).sum(axis=1) / size
        return mean, np.sqrt((np.where(have, x - mean[:, None], 0.0) ** 2).sum(axis=1) / size)

    mean, std = moments(v)
    rate, volatility = moments(err)
    alpha = 2 / (10 + 1)
    ema = np.full(len(v), np.nan)
    for column in v.T:
        ema = np.where(np.isnan(ema), column, alpha * column + (1 - alpha) * ema)
    place = np.where(have, np.arange(n) - (n - 1 + n - size[:, None]) / 2, 0.0)
    spread = (place ** 2).sum(axis=1)
    slope = np.divide((place * np.where(have, v - mean[:, None], 0.0)).sum(axis=1), spread, out=np.zeros(len(v)), where=spread > 0)
    running = pd.Series([st.get("ema", 0.0), *rt]).ewm(alpha=alpha, adjust=False).mean().to_numpy()[1:]
    seen = st.get("seen", 0) + np.arange(1, len(v) + 1)
    scored = seen % every == 0
    risk = np.minimum(1.0, 3 * rate + 2 * np.maximum(0.0, mean / 1000.0 - 0.5))

    def lag(by):
        return np.where(np.isnan(v[:, n - 1 - by]), v[:, -1], v[:, n - 1 - by])

    out = pd.DataFrame({
        "rt_mean": mean, "rt_std": std, "err_rate": rate, "err_vol": volatility, "lag1_rt": lag(1), "lag5_rt": lag(5),
        "ema10_slice": ema, "latency_slope": slope, "latency_spike": ((std > 0) & (v[:, -1] > mean + 2 * std)).astype(float),
        "error_burst": (rate > 0.5).astype(float), "ema10_running": running, "n_seen": seen, "scored": scored,
        "risk": pd.Series(risk).where(scored, None).astype(object)})
    return out, {"buf": np.concatenate([old, new])[-BUFFER:].tolist(), "ema": float(running[-1]), "seen": int(seen[-1])}


def _features_fn(key, pdfs, state):
    st = json.loads(state.get[0]) if state.exists else {}
    # a key's rows may come in several Arrow batches: order all of the micro-batch
    pdf = pd.concat(list(pdfs)).sort_values(["timestamp", "event_id"], ignore_index=True)
    if len(pdf):
        rows, st = online_rows(pdf["response_time"].to_numpy(float), pdf["success"].to_numpy(float), st)
        state.update((json.dumps(st),))
        yield pd.concat([pdf[["event_id"]].assign(api_name=key[0]), pdf[["timestamp"]], rows], axis=1)


def stream_features(stream: DataFrame) -> DataFrame:
    """STR-01/02/03/04: keyed online features with a bounded ring buffer."""
    return stream.groupBy("api_name").applyInPandasWithState(
        _features_fn, FEATURE_OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def online_features_batch(df: DataFrame, n: int = ONLINE_N, key: str = "api_name",
                          order=("timestamp", "event_id")) -> DataFrame:
    """Batch twin of :func:`stream_features` (windows over the last n rows),
    used to check stream = batch."""
    w = Window.partitionBy(key).orderBy(*order)
    fr = w.rowsBetween(-(n - 1), 0)
    rt = F.col("response_time")
    err = (F.lit(1) - F.col("success")).cast("double")
    a10 = 2 / (10 + 1)
    sl = F.collect_list(rt).over(fr)
    ema_slice = F.aggregate(F.slice(sl, 2, n), sl[0],
                            lambda acc, x: F.lit(a10) * x + F.lit(1 - a10) * acc)
    pos = F.row_number().over(w).cast("double")
    return df.select(
        "event_id", key, "timestamp",
        F.avg(rt).over(fr).alias("rt_mean"),
        F.coalesce(F.stddev_pop(rt).over(fr), F.lit(0.0)).alias("rt_std"),
        F.avg(err).over(fr).alias("err_rate"),
        F.coalesce(F.stddev_pop(err).over(fr), F.lit(0.0)).alias("err_vol"),
        F.coalesce(F.lag(rt, 1).over(w), rt).alias("lag1_rt"),
        F.coalesce(F.lag(rt, 5).over(w), rt).alias("lag5_rt"),
        ema_slice.alias("ema10_slice"),
        F.coalesce(F.regr_slope(rt, pos).over(fr), F.lit(0.0)).alias("latency_slope"),
    )


# --- STR-05 / STR-10 routing and the heal event feed ---------------------------------------------------
ROUTE_STREAM_OUT = T.StructType([
    T.StructField("api_name", T.StringType()), T.StructField("tick", T.TimestampType()),
    T.StructField("active", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("alert", T.BooleanType()), T.StructField("action", T.StringType()),
])


def stream_route(ticks: DataFrame, routes, primary: str, hi: float = C.ROUTE_HI, lo: float = C.ROUTE_LO,
                 cooldown: int = C.ROUTE_COOLDOWN) -> DataFrame:
    """STR-05: the route machine as keyed streaming state over (api_name, tick,
    risks map) rows, in tick order within a micro-batch."""
    routes = list(routes)
    machine = stateful.route_machine(routes, primary, cooldown)

    def fn(key, pdfs, state):
        mode = (int(state.get[0]) if state.exists else machine.start[0], None)
        rows = []
        for tick, symbol in pd.concat(list(pdfs)).sort_values("tick")[["tick", "symbol"]].itertuples(index=False):
            mode, out = machine.step(mode, 0.0, symbol)
            active, label, alert, _, action = stateful.route_outputs(None, machine.modes[mode[0]], out)
            rows.append((key[0], tick, active, label, alert, action))
        state.update((str(mode[0]),))
        if rows:
            yield pd.DataFrame(rows, columns=ROUTE_STREAM_OUT.names)

    symbols = ticks.select("api_name", "tick", stateful.route_symbol(F.col("risks"), routes, primary, hi, lo).alias("symbol"))
    return symbols.groupBy("api_name").applyInPandasWithState(fn, ROUTE_STREAM_OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def event_feed(routed: DataFrame) -> DataFrame:
    """STR-10: the routed ticks that change where traffic goes or raise an alert."""
    return routed.where(F.col("action").isin("reroute", "rehop", "failback") | F.col("alert"))

"""Online features in event-time order (STR-01/02/03): a reorder buffer before the ring.

Requests of an API may arrive late, also by several micro-batches; the reorder buffer
of ``faultline.streaming.ordered`` holds them until the watermark has passed, and they
go through the ring of the last 250 records in order of (timestamp, event_id).

Per record: the 43 model features over the last 21 records (null until an API has 30),
the zero-seeded running averages, and health over the last 50, 100 and 200.  Lags run
along the API's series.  A record without success counts as failed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline import constants as C
from faultline.session import ship_package
from faultline.streaming.ordered import InOrder

RING = 250
SLICE = 21
BLOCK = 4096  # rows worked on at once
UNHEALTHY = 0.3
RUNNING = ("ema10_running", "ema30_running", "err_ema10_running")
HEALTH = [f"{c}_{n}" for n in C.HEALTH_WINDOWS for c in ("avg_rt", "p95_rt", "error_rate", "status")]
OUT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("api_name", T.StringType()), T.StructField("ts_us", T.LongType()),
                    T.StructField("n_seen", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in C.FEATURE_COLS],
                    *[T.StructField(c, T.DoubleType()) for c in RUNNING],
                    *[T.StructField(c, T.StringType() if c.startswith("status") else T.DoubleType()) for c in HEALTH]])
PENDING = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts_us", T.LongType()),
                        T.StructField("rt", T.DoubleType()), T.StructField("ok", T.DoubleType())])
KEPT = T.StructType([T.StructField("ring", T.BinaryType()), T.StructField("running", T.BinaryType()), T.StructField("seen", T.LongType())])


def _windows(old: np.ndarray, new: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` values up to each new one, oldest first, NaN where there are fewer."""
    both = np.concatenate([np.full(n, np.nan), old, new])
    return np.lib.stride_tricks.sliding_window_view(both, n)[len(both) - n + 1 - len(new):]


def _moments(x: np.ndarray, have: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean = np.where(have, x, 0.0).sum(axis=1) / size
    return mean, np.sqrt((np.where(have, x - mean[:, None], 0.0) ** 2).sum(axis=1) / size)


def _slope(x: np.ndarray, mean: np.ndarray, have: np.ndarray, size: np.ndarray) -> np.ndarray:
    place = np.where(have, np.arange(x.shape[1]) - (2 * x.shape[1] - 1 - size[:, None]) / 2, 0.0)
    spread = (place ** 2).sum(axis=1)
    return np.divide((place * np.where(have, x - mean[:, None], 0.0)).sum(axis=1), spread, out=np.zeros(len(x)), where=spread > 0)


def _ema(x: np.ndarray, span: int) -> np.ndarray:
    """Over each window, seeded with its first value."""
    a, out = 2 / (span + 1), np.full(len(x), np.nan)
    for column in x.T:
        out = np.where(np.isnan(out), column, a * column + (1 - a) * out)
    return out


def _running(x: np.ndarray, span: int, last: float) -> np.ndarray:
    return pd.Series([last, *x]).ewm(alpha=2 / (span + 1), adjust=False).mean().to_numpy()[1:]


def feature_rows(api: str, ts_us: np.ndarray, rt: np.ndarray, ok: np.ndarray, ring: np.ndarray, running: np.ndarray, seen: int):
    """Features of new records in order, and the ring, running averages and count after them."""
    err = 1.0 - ok
    v, e = _windows(ring[:, 0], rt, SLICE), 1.0 - _windows(ring[:, 1], ok, SLICE)
    have = ~np.isnan(v)
    size = have.sum(axis=1)
    mean, std = _moments(v, have, size)
    rate, vol = _moments(e, have, size)
    days, secs = ts_us // 86_400_000_000, ts_us // 1_000_000 % 86_400
    hour, dow = (secs // 3600).astype(float), ((days + 3) % 7).astype(float)
    dates = days.astype("datetime64[D]")
    month = dates.astype("datetime64[M]").astype(int) % 12 + 1
    day = (dates - dates.astype("datetime64[M]")).astype(int) + 1
    no = seen + np.arange(1, len(rt) + 1)

    def back(x: np.ndarray, k: int, default: np.ndarray) -> np.ndarray:
        return np.where(np.isnan(x[:, -1 - k]), default, x[:, -1 - k])

    lag1, lag5, err1 = back(v, 1, rt), back(v, 5, rt), back(e, 1, err)
    err2 = back(e, 2, np.zeros(len(rt)))
    base = np.where(mean > 0, mean, 0.3)
    old_half = np.maximum(1, size // 2)
    new_half = size - old_half
    fast, hard = C.ONLINE_FLAGS.get(api, C.ONLINE_FLAGS["transaction_api"])
    f = {
        "response_time": rt, "request_count": no.astype(float), "hour": hour, "day_of_week": dow,
        "is_market_hours": (hour >= 9) & (hour < 17), "is_financial_peak": (hour == 9) | (hour == 14), "is_weekend": dow >= 5,
        "is_holiday": np.isin(month * 100 + day, [100 * a + b for a, b in C.ONLINE_HOLIDAYS]),
        "response_time_rolling_mean": mean, "response_time_rolling_std": std, "error_rate_rolling": rate,
        "response_time_variance": std ** 2, "error_volatility": vol, "response_time_lag_1": lag1, "response_time_lag_5": lag5, "error_rate_lag_1": err1,
        "response_time_ema_10": _ema(v, 10), "response_time_ema_30": _ema(v, 30), "error_rate_ema_10": _ema(e, 10),
        "hour_sin": np.sin(2 * np.pi * hour / 24), "hour_cos": np.cos(2 * np.pi * hour / 24),
        "dow_sin": np.sin(2 * np.pi * dow / 7), "dow_cos": np.cos(2 * np.pi * dow / 7), "high_frequency_api": np.full(len(rt), fast),
        "api_complexity": np.full(len(rt), hard), "error_rate_boost": np.maximum(0.0, rate - 0.05), "rt_multiplier": rt / base,
        "latency_diff_1": rt - lag1, "latency_diff_5": rt - lag5, "error_rate_diff_1": err1 - err2,
        "error_rate_diff_5": err1 - np.where(e[:, -7] == 0.0, 0.0, err1), "latency_spike": (std > 0) & (rt > mean + 2 * std),
        "error_burst": rate > 0.5, "instability_index": np.minimum(1.0, std / base + vol), "latency_slope": _slope(v, mean, have, size),
        "error_slope": _slope(e, rate, have, size), "traffic_change": (new_half - old_half) / old_half, "burst_ratio": new_half / old_half,
    }
    zero = np.zeros(len(rt))  # the other APIs' statistics are not known inside one key
    enough = no >= C.ONLINE_MIN_RECORDS
    out = {c: np.where(enough, np.asarray(f.get(c, zero), float), np.nan) for c in C.FEATURE_COLS}
    runs = [_running(rt, 10, running[0]), _running(rt, 30, running[1]), _running(err, 10, running[2])]
    out |= dict(zip(RUNNING, runs))
    for n in C.HEALTH_WINDOWS:
        w, x = _windows(ring[:, 0], rt, n), 1.0 - _windows(ring[:, 1], ok, n)
        m = (~np.isnan(w)).sum(axis=1)
        bad = np.nansum(x, axis=1) / m
        out |= {f"avg_rt_{n}": np.nansum(w, axis=1, dtype=np.longdouble).astype(float) / m, f"p95_rt_{n}": np.sort(w, axis=1)[np.arange(len(w)), (m * 0.95).astype(int)],
                f"error_rate_{n}": bad, f"status_{n}": np.where(bad > UNHEALTHY, "unhealthy", "healthy")}
    rows = pd.DataFrame({"n_seen": no, **out})  # NaN becomes null
    return rows, np.concatenate([ring, np.column_stack([rt, ok])])[-RING:], np.array([r[-1] for r in runs]), int(no[-1])


class OnlineFeatures(InOrder):
    """The ring and what runs beside it, per API."""

    held = PENDING
    order = ("ts_us", "event_id")

    def setup(self, handle) -> None:
        self.kept = handle.getValueState("kept", KEPT)

    def due(self, key, ready: pd.DataFrame, watermark: int) -> Iterator[pd.DataFrame]:
        if ready.empty:
            return
        ring, running, seen = np.zeros((0, 2)), np.zeros(3), 0
        if self.kept.exists():
            raw = self.kept.get()
            ring, running, seen = np.frombuffer(raw[0]).reshape(-1, 2), np.frombuffer(raw[1]), raw[2]
        for a in range(0, len(ready), BLOCK):
            part = ready.iloc[a: a + BLOCK]
            ts, rt, ok = (part[c].to_numpy(t) for c, t in (("ts_us", np.int64), ("rt", float), ("ok", float)))
            out, ring, running, seen = feature_rows(key[0], ts, rt, ok, ring, running, seen)
            yield pd.concat([part[["event_id"]].reset_index(drop=True).assign(api_name=key[0], ts_us=ts), out], axis=1)[OUT.names]
        self.kept.update((ring.tobytes(), running.tobytes(), seen))


def online_features(stream: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """STR-01/02/03 over a request stream (event_id, timestamp, api_name,
    response_time, success), rows up to ``delay`` late included in their place.
    Start the query inside ``ordered.rocksdb``."""
    ship_package(stream.sparkSession)
    rows = stream.withWatermark("timestamp", delay).select(
        "timestamp", "api_name", "event_id", F.unix_micros("timestamp").alias("ts_us"), F.col("response_time").alias("rt"),
        F.coalesce(F.col("success"), F.lit(0)).cast("double").alias("ok"))
    out = rows.groupBy("api_name").transformWithStateInPandas(OnlineFeatures(), OUT, "append", "eventTime")
    return out.withColumn("timestamp", F.timestamp_micros("ts_us")).drop("ts_us")

"""Per-API time-series feature engineering (WIN-02..19, SCL-01..03, PRJ-04).

One shuffle builds every windowed column: rows are range-indexed per API
(``series.with_row_index``), cut into halo blocks, and all rolling / lag / EMA
columns are computed in a single ``select`` over one (api, block) window so
Catalyst plans one Exchange + Sort for all of them.

Profiles (``PROFILES``) capture the dialects of the same 43-column contract:
``batch60`` (canonical), ``batch20`` and ``batch10``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions import scalars as S
from faultline.operators import series
from faultline.operators.joins import flag_holidays
from faultline.session import broadcast_if_small


@dataclass(frozen=True)
class Profile:
    name: str
    n: int                      # rolling frame (rows, incl. current)
    vol_n: int                  # error-volatility frame
    adjust: bool                # EMA adjust flag
    spans: tuple = (10, 30)
    stress_from_data: bool = True   # error_rate_boost / rt_multiplier from data
    boost_baseline: float = 0.07
    round_outputs: bool = True
    complexity: dict = field(default_factory=lambda: dict(C.API_COMPLEXITY))
    high_freq: tuple = ("crypto_api",)
    calendar: str = "batch60"


PROFILES = {
    "batch60": Profile("batch60", 60, 30, True),
    "batch20": Profile("batch20", 20, 20, False, stress_from_data=False, round_outputs=False,
                       complexity=dict(C.API_COMPLEXITY_BATCH20),
                       high_freq=tuple(C.HIGH_FREQ_BATCH20), calendar="batch20"),
    "batch10": Profile("batch10", 10, 10, True, stress_from_data=False, round_outputs=False),
}

BASE_COLS = ["event_id", "timestamp", "api_name", "response_time", "status_code",
             "success", "error_type", "request_count"]


def _r(c: Column, nd: int, on: bool) -> Column:
    return S.np_round(c, nd) if on else c


def exact_mean(n: Column, s: Column, scale: float) -> Column:
    """Mean from an exact integer sum: one correctly rounded division."""
    return s.cast("double") / (n * F.lit(scale))


def exact_std(n: Column, s: Column, s2: Column, scale: float) -> Column:
    """Sample std from exact integer moments (n*S2 - S^2 in DECIMAL(38,0));
    NULL for a single row.  Order-independent, so every engine agrees."""
    d = "decimal(38,0)"
    num = n.cast(d) * s2.cast(d) - s.cast(d) * s.cast(d)
    var = num.cast("double") / (n * (n - F.lit(1)) * F.lit(scale * scale))
    return F.when(n > 1, F.sqrt(var))


def _map(d: dict, key: Column, default) -> Column:
    m = F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.element_at(m, key), F.lit(default))


def series_features(tele: DataFrame, profile: str | Profile = "batch60",
                    key: str = "api_name", order=("timestamp", "event_id"),
                    keep=("data_source",), block: int | None = None,
                    horizons=(), recent_n: int = 0, decimals: int | None = None) -> DataFrame:
    """Telemetry -> base + calendar + rolling/lag/EMA + stress + precursor columns.

    ``horizons`` adds ``y_h{h}`` (failure flag h rows ahead) and
    ``y_type_h{h}`` (its error type); ``recent_n`` adds ``recent_failures``
    (failures among the previous n rows).  Both come out of the same window
    pass (forward halo = max horizon), so they cost no extra shuffle.

    Rolling statistics are plain double windows.  ``decimals`` states that every
    response time has at most so many decimals (a row that has more fails the
    job); sums are then exact integers, equal in any order of evaluation.
    """
    p = PROFILES[profile] if isinstance(profile, str) else profile
    rnd = p.round_outputs
    keep = [c for c in keep if c in tele.columns]
    cols = [c for c in BASE_COLS if c in tele.columns] + keep
    t = tele.select(*cols)

    back = max(p.n - 1, p.vol_n - 1, 5, max(series.ema_halo(s) for s in p.spans))
    back = max(back, recent_n)
    fwd = max(horizons) if horizons else 0
    blk_size = block or series.ema_block_size(p.spans, back, fwd)
    idx = series.with_row_index(t, key=key, order=order)
    b = series.blocked(idx, block=blk_size, back=back, fwd=fwd)
    w = series.block_window(key)
    fn = w.rowsBetween(-(p.n - 1), 0)
    rt = F.col("response_time").cast("double")
    err = (F.lit(1) - F.col("success")).cast("double")
    rc = F.col("request_count").cast("double")
    ierr = (F.lit(1) - F.col("success")).cast("long")
    whole = {"err": ierr}  # whole numbers: sums over a frame are differences of running sums
    if dict(tele.dtypes)["request_count"] in ("tinyint", "smallint", "int"):
        whole["rc"] = F.col("request_count").cast("long")
    if decimals is None:
        moments = [F.avg(rt).over(fn).alias("_rt_mean"), F.stddev_samp(rt).over(fn).alias("_rt_std")]
        series_mean = F.avg(rt)
    else:
        unit = float(10 ** decimals)
        scaled = F.round(rt * F.lit(unit))
        units = F.when(F.abs(rt * F.lit(unit) - scaled) > 1e-4, F.raise_error(F.lit(
            f"response_time has more than {decimals} decimals"))).otherwise(scaled).cast("long")
        moments = []
        # squares in two parts: a running sum of a block is far longer than a frame's
        whole |= {"u": units, "hi": F.shiftright(units * units, 31), "lo": (units * units).bitwiseAND(F.lit((1 << 31) - 1))}
        series_mean = F.sum(scaled.cast("long")).cast("double") / (F.count(F.lit(1)) * F.lit(unit))
    s_fast, s_slow = p.spans[0], p.spans[1]
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    win = b.select(
        *cols, "row_idx", "_home", "_blk",
        F.row_number().over(w).cast("long").alias("_at"),
        *moments,
        *[F.sum(F.coalesce(x, F.lit(0).cast("long"))).over(run).alias(f"_sum_{k}") for k, x in whole.items()],
        *[F.count(x).over(run).alias(f"_count_{k}") for k, x in whole.items() if k not in ("hi", "lo")],
        F.lag(rt, 1).over(w).alias("_rt_lag1"),
        F.lag(rt, 5).over(w).alias("_rt_lag5"),
        F.lag(err, 1).over(w).alias("_err_lag1"),
        series.ema_columns(rt, s_fast, w, adjust=p.adjust).alias("_rt_ema_fast"),
        series.ema_columns(rt, s_slow, w, adjust=p.adjust).alias("_rt_ema_slow"),
        series.ema_columns(err, s_fast, w, adjust=p.adjust).alias("_err_ema_fast"),
        *([] if "rc" in whole else [F.avg(rc).over(w.rowsBetween(-59, 0)).alias("_rc_mean60")]),
        F.lag(rc, 1).over(w).alias("_rc_lag1"),
        *[F.lead(ierr, h).over(w).cast("int").alias(f"y_h{h}") for h in horizons],
        *[F.lead("error_type", h).over(w).alias(f"y_type_h{h}") for h in horizons],
    )

    def upto(column: str, rows: int) -> Column:
        """The running ``column`` as it was ``rows`` rows before."""
        return F.coalesce(F.lag(column, rows).over(w), F.lit(0).cast("long"))

    def last(k: str, rows: int, of: str | None = None) -> Column:
        """Sum of the last ``rows`` rows; null if none has a value (of ``of``)."""
        n = F.col(f"_count_{of or k}") - upto(f"_count_{of or k}", rows)
        return F.when(n > 0, F.col(f"_sum_{k}") - upto(f"_sum_{k}", rows))

    n, sums = F.least(F.col("_at"), F.lit(p.n).cast("long")), []
    if decimals is not None:
        total, squares = last("u", p.n), last("hi", p.n, "u") * F.lit(1 << 31) + last("lo", p.n, "u")
        sums += [exact_mean(n, total, unit).alias("_rt_mean"), exact_std(n, total, squares, unit).alias("_rt_std")]
    if "rc" in whole:
        sums.append((last("rc", 60).cast("double") / (F.col("_count_rc") - upto("_count_rc", 60))).alias("_rc_mean60"))
    if recent_n:
        sums.append((upto("_sum_err", 1) - upto("_sum_err", recent_n + 1)).cast("double").alias("recent_failures"))
    kept = [c for c in win.columns if not c.startswith(("_sum_", "_count_")) and c not in ("_blk", "_at")]
    win = win.select(*kept, n.alias("_n"), last("err", p.n).alias("_se"), F.least(F.col("_at"), F.lit(p.vol_n).cast("long")).alias("_nv"),
                     last("err", p.vol_n).alias("_sev"), *sums).filter("_home")

    # lag fill = series mean (per key; one row per key)
    means = broadcast_if_small(t.groupBy(key).agg(series_mean.alias("_series_mean")))
    win = win.join(means, key, "left")

    out = _derive(win, p, key)
    return out


def _derive(win: DataFrame, p: Profile, key: str) -> DataFrame:
    rnd = p.round_outputs
    holiday = F.col("is_holiday") if "is_holiday" in win.columns else None
    win = flag_holidays(win, "timestamp") if holiday is None else win
    cal = S.calendar_features("timestamp", F.col("is_holiday"), p.calendar)
    rt = F.col("response_time")
    std, mean = F.coalesce("_rt_std", F.lit(0.0)), F.col("_rt_mean")
    err_rate = exact_mean(F.col("_n"), F.col("_se"), 1.0)
    err_vol = exact_std(F.col("_nv"), F.col("_sev"), F.col("_sev"), 1.0)
    rt_ema_slow = F.col("_rt_ema_slow")
    step1 = win.select(
        *[c for c in win.columns if not c.startswith("_") and c not in cal and c != "row_idx"],
        "row_idx",
        *[v.alias(k) for k, v in cal.items()],
        _r(mean, 4, rnd).alias("response_time_rolling_mean"),
        _r(std, 4, rnd).alias("response_time_rolling_std"),
        _r(err_rate, 4, rnd).alias("error_rate_rolling"),
        _r(std * std, 4, rnd).alias("response_time_variance"),
        _r(F.coalesce(err_vol, F.lit(0.0)), 4, rnd).alias("error_volatility"),
        _r(F.coalesce(F.col("_rt_lag1"), F.col("_series_mean")), 2, rnd).alias("response_time_lag_1"),
        _r(F.coalesce(F.col("_rt_lag5"), F.col("_series_mean")), 2, rnd).alias("response_time_lag_5"),
        _r(F.coalesce(F.col("_err_lag1"), F.lit(0.0)), 4, rnd).alias("error_rate_lag_1"),
        _r(F.col("_rt_ema_fast"), 4, rnd).alias("response_time_ema_10"),
        _r(rt_ema_slow, 4, rnd).alias("response_time_ema_30"),
        _r(F.col("_err_ema_fast"), 4, rnd).alias("error_rate_ema_10"),
        _map(p.complexity, F.col(key), 1.0).alias("api_complexity"),
        F.col(key).isin(*p.high_freq).cast("int").alias("high_frequency_api"),
        (_r(F.greatest(F.lit(0.0), err_rate - F.lit(p.boost_baseline)), 4, True)
         if p.stress_from_data else F.lit(0.0)).alias("error_rate_boost"),
        (_r(S.clip(F.when(rt_ema_slow > 0, rt / rt_ema_slow).otherwise(F.lit(1.0)), 1.0, 10.0), 4, True)
         if p.stress_from_data else F.lit(1.0)).alias("rt_multiplier"),
        (F.col("request_count") - F.coalesce(F.col("_rc_lag1"), F.col("request_count"))).cast("double")
        .alias("traffic_change"),
        (F.col("request_count") / (F.col("_rc_mean60") + F.lit(C.EPS))).alias("burst_ratio"),
    )
    step1 = step1.select(
        "*",
        _r(S.cyclical(F.col("hour"), 24, "sin"), 6, rnd).alias("hour_sin"),
        _r(S.cyclical(F.col("hour"), 24, "cos"), 6, rnd).alias("hour_cos"),
        _r(S.cyclical(F.col("day_of_week"), 7, "sin"), 6, rnd).alias("dow_sin"),
        _r(S.cyclical(F.col("day_of_week"), 7, "cos"), 6, rnd).alias("dow_cos"),
    )
    return precursors(step1)


def precursors(df: DataFrame, eps: float = C.EPS) -> DataFrame:
    """WIN-12..15: row-wise precursors from stored columns; existing columns
    are kept as they are (idempotent add, PRJ-04)."""
    rt = F.col("response_time")
    defs = {
        "latency_diff_1": F.coalesce(rt - F.col("response_time_lag_1"), F.lit(0.0)),
        "latency_diff_5": F.coalesce(rt - F.col("response_time_lag_5"), F.lit(0.0)),
        "error_rate_diff_1": F.coalesce(F.col("error_rate_rolling") - F.col("error_rate_lag_1"), F.lit(0.0)),
        "error_rate_diff_5": F.coalesce(F.col("error_rate_rolling") - F.col("error_rate_ema_10"), F.lit(0.0)),
        "latency_spike": rt / (F.col("response_time_rolling_mean") + F.lit(eps)),
        "error_burst": F.col("error_rate_rolling") / (F.col("error_rate_ema_10") + F.lit(eps)),
    }
    out = df
    for name, expr in defs.items():
        if name not in out.columns:
            out = out.withColumn(name, expr)
    more = {
        "instability_index": F.abs(F.col("latency_diff_1")) + F.abs(F.col("error_rate_diff_1")),
        "latency_slope": (F.col("response_time_ema_10") - F.col("response_time_ema_30")) / F.lit(20.0),
        "error_slope": F.coalesce((F.col("error_rate_ema_10") - F.col("error_rate_lag_1")) / F.lit(10.0),
                                  F.lit(0.0)),
    }
    for name, expr in more.items():
        if name not in out.columns:
            out = out.withColumn(name, expr)
    return out


def interactions(df: DataFrame) -> DataFrame:
    """WIN-27: rt*rc/100 and error_rate_rolling * is_financial_peak."""
    return df.select(
        "*",
        (F.col("response_time") * F.col("request_count") / F.lit(100.0)).alias("rt_x_load"),
        (F.col("error_rate_rolling") * F.col("is_financial_peak")).alias("err_x_peak"),
    )

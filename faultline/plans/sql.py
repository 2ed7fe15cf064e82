"""DuckDB oracle SQL builders.

These strings are the independent, plain-SQL statement of what each Spark
plan computes (plain per-API windows, a recursive CTE for the EMA
recurrence).  They are only used by the correctness check, never by the
engine itself.
"""

from __future__ import annotations

import math

from faultline import constants as C
from faultline.functions.scalars import np_round_sql as R
from faultline.sources.fixtures import ledger_sql, telemetry_sql

TWO_PI = 2 * math.pi


def q(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def _map_case(col: str, d: dict, default) -> str:
    parts = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in d.items())
    return f"COALESCE(CASE {col} {parts} END, {default!r})"


def features_ctes(profile: str = "batch60") -> str:
    """CTEs ending in ``feat`` (per-row batch60 features, before cross-API)."""
    assert profile == "batch60"
    q10, q30 = q(10), q(30)
    hol = ", ".join(f"DATE '{h}'" for h in C.HOLIDAYS)
    return f"""{telemetry_sql()},
idx AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER (PARTITION BY api_name ORDER BY "timestamp", event_id) - 1 AS BIGINT) AS row_idx,
         CAST(1 - success AS DOUBLE) AS err,
         CAST(1 - success AS BIGINT) AS ierr,
         CAST(round(CAST(response_time AS DOUBLE) * 100.0::DOUBLE) AS BIGINT) AS cents,
         CAST(response_time AS DOUBLE) AS rt
  FROM telemetry
),
ema(api_name, row_idx, n10, d10, n30, d30, en10) AS (
  SELECT api_name, row_idx, rt, 1.0::DOUBLE, rt, 1.0::DOUBLE, err FROM idx WHERE row_idx = 0
  UNION ALL
  SELECT i.api_name, i.row_idx,
         i.rt + {q10!r} * e.n10, 1.0 + {q10!r} * e.d10,
         i.rt + {q30!r} * e.n30, 1.0 + {q30!r} * e.d30,
         i.err + {q10!r} * e.en10
  FROM ema e JOIN idx i ON i.api_name = e.api_name AND i.row_idx = e.row_idx + 1
),
win AS (
  SELECT i.*,
    count(*) OVER w60 AS _n,
    sum(cents) OVER w60 AS _sc,
    sum(cents * cents) OVER w60 AS _sc2,
    sum(ierr) OVER w60 AS _se,
    count(*) OVER w30 AS _nv,
    sum(ierr) OVER w30 AS _sev,
    lag(rt, 1) OVER w AS _rt_lag1,
    lag(rt, 5) OVER w AS _rt_lag5,
    lag(err, 1) OVER w AS _err_lag1,
    avg(CAST(request_count AS DOUBLE)) OVER w60 AS _rc_mean60,
    lag(request_count, 1) OVER w AS _rc_lag1,
    CAST(sum(cents) OVER (PARTITION BY api_name) AS DOUBLE)
      / (count(*) OVER (PARTITION BY api_name) * 100.0::DOUBLE) AS _series_mean,
    e.n10 / e.d10 AS _rt_ema10, e.n30 / e.d30 AS _rt_ema30, e.en10 / e.d10 AS _err_ema10
  FROM idx i JOIN ema e USING (api_name, row_idx)
  WINDOW w AS (PARTITION BY api_name ORDER BY row_idx),
         w60 AS (PARTITION BY api_name ORDER BY row_idx ROWS BETWEEN 59 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY api_name ORDER BY row_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
),
mom AS (
  SELECT *,
    CAST(_sc AS DOUBLE) / (_n * 100.0::DOUBLE) AS _rt_mean,
    coalesce(CASE WHEN _n > 1 THEN sqrt(CAST(CAST(_n AS HUGEINT) * _sc2 - CAST(_sc AS HUGEINT) * _sc AS DOUBLE)
                  / (_n * (_n - 1) * 10000.0::DOUBLE)) END, 0.0) AS _rt_std,
    CAST(_se AS DOUBLE) / (_n * 1.0::DOUBLE) AS _err_rate,
    CASE WHEN _nv > 1 THEN sqrt(CAST(CAST(_nv AS HUGEINT) * _sev - CAST(_sev AS HUGEINT) * _sev AS DOUBLE)
                  / (_nv * (_nv - 1) * 1.0::DOUBLE)) END AS _err_vol
  FROM win
),
cal AS (
  SELECT *, hour("timestamp") AS hour, isodow("timestamp") - 1 AS day_of_week,
         CASE WHEN CAST("timestamp" AS DATE) IN ({hol}) THEN 1 ELSE 0 END AS is_holiday
  FROM mom
),
base AS (
  SELECT event_id, "timestamp", api_name, response_time, status_code, success, error_type,
         request_count, data_source, row_idx,
         hour, day_of_week,
         CASE WHEN day_of_week >= 5 THEN 1 ELSE 0 END AS is_weekend,
         is_holiday,
         CASE WHEN hour >= 9 AND hour <= 16 AND NOT (day_of_week >= 5 OR is_holiday = 1) THEN 1 ELSE 0 END AS is_market_hours,
         CASE WHEN hour >= 9 AND hour <= 16 AND NOT (day_of_week >= 5 OR is_holiday = 1) THEN 1 ELSE 0 END AS is_financial_peak,
         CASE WHEN hour >= 7 AND hour < 9 THEN 1 ELSE 0 END AS is_pre_open,
         CASE WHEN hour >= 16 AND hour <= 18 THEN 1 ELSE 0 END AS is_market_close,
         {R('_rt_mean', 4)} AS response_time_rolling_mean,
         {R('_rt_std', 4)} AS response_time_rolling_std,
         {R('_err_rate', 4)} AS error_rate_rolling,
         {R('_rt_std * _rt_std', 4)} AS response_time_variance,
         {R('coalesce(_err_vol, 0.0)', 4)} AS error_volatility,
         {R('coalesce(_rt_lag1, _series_mean)', 2)} AS response_time_lag_1,
         {R('coalesce(_rt_lag5, _series_mean)', 2)} AS response_time_lag_5,
         {R('coalesce(_err_lag1, 0.0)', 4)} AS error_rate_lag_1,
         {R('_rt_ema10', 4)} AS response_time_ema_10,
         {R('_rt_ema30', 4)} AS response_time_ema_30,
         {R('_err_ema10', 4)} AS error_rate_ema_10,
         {_map_case('api_name', C.API_COMPLEXITY, 1.0)} AS api_complexity,
         CASE WHEN api_name IN ('crypto_api') THEN 1 ELSE 0 END AS high_frequency_api,
         {R('greatest(0.0, _err_rate - 0.07)', 4)} AS error_rate_boost,
         {R('least(greatest(CASE WHEN _rt_ema30 > 0 THEN response_time / _rt_ema30 ELSE 1.0 END, 1.0), 10.0)', 4)} AS rt_multiplier,
         CAST(request_count - coalesce(_rc_lag1, request_count) AS DOUBLE) AS traffic_change,
         request_count / (_rc_mean60 + 1e-06) AS burst_ratio,
         {R(f'sin({TWO_PI!r} * hour / 24.0)', 6)} AS hour_sin,
         {R(f'cos({TWO_PI!r} * hour / 24.0)', 6)} AS hour_cos,
         {R(f'sin({TWO_PI!r} * day_of_week / 7.0)', 6)} AS dow_sin,
         {R(f'cos({TWO_PI!r} * day_of_week / 7.0)', 6)} AS dow_cos
  FROM cal
),
pre AS (
  SELECT *,
    coalesce(response_time - response_time_lag_1, 0.0) AS latency_diff_1,
    coalesce(response_time - response_time_lag_5, 0.0) AS latency_diff_5,
    coalesce(error_rate_rolling - error_rate_lag_1, 0.0) AS error_rate_diff_1,
    coalesce(error_rate_rolling - error_rate_ema_10, 0.0) AS error_rate_diff_5,
    response_time / (response_time_rolling_mean + 1e-06) AS latency_spike,
    error_rate_rolling / (error_rate_ema_10 + 1e-06) AS error_burst
  FROM base
),
feat AS (
  SELECT *,
    abs(latency_diff_1) + abs(error_rate_diff_1) AS instability_index,
    (response_time_ema_10 - response_time_ema_30) / 20.0 AS latency_slope,
    coalesce((error_rate_ema_10 - error_rate_lag_1) / 10.0, 0.0) AS error_slope
  FROM pre
)"""


def cross_ctes(src: str = "feat", threshold: float = 0.05) -> str:
    """CTEs ending in ``full_feat``: ``src`` plus the five cross-API features."""
    apis = C.ALL_APIS
    vals = ", ".join(f"('{a}')" for a in apis)
    wide_cols = ",\n    ".join(f"max(CASE WHEN api_name = '{a}' THEN v END) AS \"{a}\"" for a in apis)
    parts = []
    for me in apis:
        others = [f'"{a}"' for a in apis if a != me]
        cnt = " + ".join(f"(CASE WHEN {o} IS NOT NULL THEN 1 ELSE 0 END)" for o in others)
        tot = " + ".join(f"coalesce({o}, 0.0)" for o in others)
        avg = f"(CASE WHEN ({cnt}) > 0 THEN ({tot}) / ({cnt}) END)"
        nel = "CAST(" + " + ".join(f"(CASE WHEN {o} > {threshold} THEN 1 ELSE 0 END)" for o in others) + " AS DOUBLE)"
        mx = "greatest(" + ", ".join(others) + ")"
        parts.append(
            f"SELECT ts_bucket, '{me}' AS api_name, {avg} AS avg_error_rate_others, {mx} AS max_error_rate_others, "
            f"{nel} AS n_apis_elevated, \"{C.SIMILAR_API[me]}\" AS corr_with_similar_api, "
            f"{avg} * {nel} AS systemic_stress_index FROM wide")
    union = "\n  UNION ALL\n  ".join(parts)
    return f"""
bm AS (
  SELECT date_trunc('minute', "timestamp") AS ts_bucket, api_name, avg(error_rate_rolling) AS v
  FROM {src} GROUP BY 1, 2
),
grid AS (
  SELECT b.ts_bucket, a.api_name FROM (SELECT DISTINCT ts_bucket FROM bm) b, (VALUES {vals}) a(api_name)
),
filled AS (
  SELECT g.ts_bucket, g.api_name,
    coalesce(last_value(bm.v IGNORE NULLS) OVER (PARTITION BY g.api_name ORDER BY g.ts_bucket
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             first_value(bm.v IGNORE NULLS) OVER (PARTITION BY g.api_name ORDER BY g.ts_bucket
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v
  FROM grid g LEFT JOIN bm USING (ts_bucket, api_name)
),
wide AS (
  SELECT ts_bucket,
    {wide_cols}
  FROM filled GROUP BY ts_bucket
),
xf AS (
  {union}
),
full_feat AS (
  SELECT s.*,
    coalesce(x.avg_error_rate_others, 0.0) AS avg_error_rate_others,
    coalesce(x.max_error_rate_others, 0.0) AS max_error_rate_others,
    coalesce(x.n_apis_elevated, 0.0) AS n_apis_elevated,
    coalesce(x.corr_with_similar_api, 0.0) AS corr_with_similar_api,
    coalesce(x.systemic_stress_index, 0.0) AS systemic_stress_index
  FROM {src} s LEFT JOIN xf x
    ON x.ts_bucket = date_trunc('minute', s."timestamp") AND x.api_name = s.api_name
)"""


def full_features_with() -> str:
    return "WITH RECURSIVE " + features_ctes() + "," + cross_ctes()


def diagnose_case() -> str:
    d = C.DIAG
    return f"""CASE
  WHEN systemic_stress_index >= {d['systemic_stress_hi']} OR n_apis_elevated >= {d['n_apis_elevated']} THEN 'cascade'
  WHEN burst_ratio >= {d['burst_ratio_hi']} OR traffic_change >= {d['traffic_change_hi']} THEN 'overload'
  WHEN rt_multiplier >= {d['rt_multiplier_hi']} OR latency_spike >= {d['latency_spike_hi']} THEN 'timeout'
  WHEN error_burst >= {d['error_burst_hi']} OR error_rate_boost >= {d['error_boost_hi']} THEN 'error_surge'
  ELSE 'intermittent' END"""


def diagnose_confidence() -> str:
    d = C.DIAG
    return R(f"""least(1.0, CASE
  WHEN systemic_stress_index >= {d['systemic_stress_hi']} OR n_apis_elevated >= {d['n_apis_elevated']}
       THEN (systemic_stress_index + max_error_rate_others) / 1.2
  WHEN burst_ratio >= {d['burst_ratio_hi']} OR traffic_change >= {d['traffic_change_hi']}
       THEN greatest(burst_ratio / 4.0, traffic_change / 3.0)
  WHEN rt_multiplier >= {d['rt_multiplier_hi']} OR latency_spike >= {d['latency_spike_hi']}
       THEN greatest(rt_multiplier / 4.0, latency_spike)
  WHEN error_burst >= {d['error_burst_hi']} OR error_rate_boost >= {d['error_boost_hi']}
       THEN greatest(error_burst, error_rate_boost + error_rate_rolling)
  ELSE instability_index + 0.2 END)""", 3)


__all__ = ["features_ctes", "cross_ctes", "full_features_with", "diagnose_case",
           "diagnose_confidence", "ledger_sql", "telemetry_sql"]

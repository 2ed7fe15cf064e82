"""Registered queries: aggregations and audit reports (AGG-*, WIN-24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.scalars import np_round_sql as R
from faultline.operators import aggregates as A
from faultline.operators import cross_api
from faultline.plans import sql as Q
from faultline.plans.catalog import register
from faultline.plans.feature_table import feature_table
from faultline.sources import fixtures as FX

T = "WITH " + FX.telemetry_sql() + "\n"
TT = "WITH " + FX.tagged_telemetry_sql() + "\n"
FT = Q.full_features_with() + "\n"


def _cents_avg(col: str) -> str:
    return f"(CAST(sum(CAST(round({col} * 100.0::DOUBLE) AS BIGINT)) AS DOUBLE) / (count({col}) * 100.0::DOUBLE))"


@register("agg_daily_summary", TT + f"""
SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS date, api_name, event_label,
       count(*) AS total_requests, sum(1 - success) AS total_failures,
       {R('avg(1 - success)', 4)} AS failure_rate,
       {R(_cents_avg('response_time'), 2)} AS avg_response_time_ms,
       {R('max(response_time)', 2)} AS max_response_time_ms
FROM tagged GROUP BY 1, 2, 3""")
def q_daily_summary(spark, sf):
    return A.daily_summary(FX.tagged_telemetry(spark, sf))


@register("agg_event_impact", TT + f"""
SELECT event_label, api_name, count(*) AS affected_rows,
       {R('avg(1 - success)', 4)} AS failure_rate,
       {R(_cents_avg('response_time'), 2)} AS avg_response_time_ms,
       {R('CAST(sum(CAST(round(error_rate_boost * 100) AS BIGINT)) AS DOUBLE) / (count(*) * 100.0::DOUBLE)', 4)} AS avg_error_boost,
       min("timestamp") AS event_start, max("timestamp") AS event_end
FROM tagged WHERE event_label <> 'normal' GROUP BY 1, 2""")
def q_event_impact(spark, sf):
    return A.event_impact(FX.tagged_telemetry(spark, sf))


@register("agg_event_distribution", TT + f"""
SELECT event_label, count(*) AS rows, avg(1 - success) AS failure_rate,
       {_cents_avg('response_time')} AS avg_rt
FROM tagged WHERE event_label <> 'normal' GROUP BY 1""")
def q_event_distribution(spark, sf):
    return A.event_distribution(FX.tagged_telemetry(spark, sf))


@register("agg_failure_rate_by_api", T + """
SELECT api_name, 1.0 - avg(success) AS failure_rate, count(*) AS n FROM telemetry GROUP BY 1""")
def q_failure_rate(spark, sf):
    return A.failure_rate(FX.telemetry(spark, sf))


@register("agg_source_breakdown", T + f"""
SELECT data_source AS source, count(*) AS rows,
       100.0 * count(*) / (SELECT count(*) FROM telemetry) AS pct,
       100.0 * count(*) / (SELECT count(*) FROM telemetry) < {C.AUDIT_SOURCE_LOW_PCT} AS flag_low,
       100.0 * count(*) / (SELECT count(*) FROM telemetry) > {C.AUDIT_SOURCE_HIGH_PCT} AS flag_dominant
FROM telemetry GROUP BY 1""")
def q_source_breakdown(spark, sf):
    return A.source_breakdown(FX.telemetry(spark, sf))


def _coverage_sql():
    parts = []
    for f in C.AUDIT_KEY_FEATURES:
        parts.append(f"SELECT data_source AS source, '{f}' AS feature, "
                     f"100.0 * sum(CASE WHEN {f} IS NOT NULL AND {f} <> 0 THEN 1 ELSE 0 END) / greatest(count(*), 1) "
                     f"AS coverage_pct FROM full_feat GROUP BY 1")
    u = "\nUNION ALL\n".join(parts)
    return FT + f""", cov AS ({u})
SELECT source, feature, coverage_pct,
       sum(CASE WHEN coverage_pct < {C.AUDIT_COVERAGE_PCT} THEN 1 ELSE 0 END) OVER (PARTITION BY source) AS n_low,
       sum(CASE WHEN coverage_pct < {C.AUDIT_COVERAGE_PCT} THEN 1 ELSE 0 END) OVER (PARTITION BY source) >= 3 AS flag_low_coverage
FROM cov"""


@register("agg_feature_coverage", _coverage_sql())
def q_feature_coverage(spark, sf):
    return A.feature_coverage(feature_table(spark, sf))


@register("agg_failure_modes", T + f"""
, per_src AS (SELECT data_source AS source, count(*) AS n_total, sum(1 - success) AS n_failures FROM telemetry GROUP BY 1),
modes AS (SELECT data_source AS source, error_type AS mode, count(*) AS count FROM telemetry WHERE success = 0 GROUP BY 1, 2)
SELECT m.source, m.mode, m.count, 100.0 * m.count / p.n_failures AS mode_pct,
       100.0 * p.n_failures / greatest(p.n_total, 1) AS source_failure_pct,
       100.0 * m.count / p.n_failures > {C.AUDIT_DOMINANT_MODE_PCT} AS flag_dominant,
       100.0 * p.n_failures / greatest(p.n_total, 1) < {C.AUDIT_FAILURE_MIN_PCT} AS flag_low_rate
FROM modes m JOIN per_src p USING (source)""".replace("\n, per_src", ",\nper_src", 1))
def q_failure_modes(spark, sf):
    return A.failure_modes(FX.telemetry(spark, sf))


@register("agg_value_counts_error_type", T + """
SELECT error_type AS value, count(*) AS count FROM telemetry GROUP BY 1""")
def q_value_counts(spark, sf):
    return A.value_counts(FX.telemetry(spark, sf), "error_type")


@register("agg_dataset_stats", T + """
SELECT count(*) AS rows, 1.0 - avg(coalesce(success, 1)) AS failure_rate,
       count(DISTINCT api_name) AS n_apis, min("timestamp") AS min_ts, max("timestamp") AS max_ts
FROM telemetry""")
def q_dataset_stats(spark, sf):
    return A.dataset_stats(FX.telemetry(spark, sf))


PROFILE_COLS = ["response_time", "request_count", "error_rate_rolling", "response_time_rolling_mean",
                "burst_ratio", "latency_spike", "error_rate_boost", "systemic_stress_index"]


def _profile_sql():
    parts = []
    for c in PROFILE_COLS:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS feature, avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS min, "
                     f"max({x}) AS max, sum(CASE WHEN {x} IS NULL OR isnan({x}) THEN 1 ELSE 0 END) AS nan_count, "
                     f"100.0 * avg(CASE WHEN {x} <> 0 THEN 1 ELSE 0 END) AS nonzero_pct FROM full_feat")
    return FT + ", prof AS (" + "\nUNION ALL\n".join(parts) + ")\nSELECT *, nonzero_pct < 10 AS warn_sparse FROM prof"


@register("agg_feature_profile", _profile_sql())
def q_feature_profile(spark, sf):
    return A.feature_profile(feature_table(spark, sf), PROFILE_COLS)


MISSING_COLS = ["event_id", "timestamp", "api_name", "response_time", "status_code", "success",
                "error_type", "request_count", "data_source"]


@register("agg_missing_values", T + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN \"{c}\" IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls FROM telemetry"
    for c in MISSING_COLS))
def q_missing_values(spark, sf):
    return A.missing_values(FX.telemetry(spark, sf).select(*MISSING_COLS))


CORR_COLS = ["response_time", "request_count", "success", "status_code"]


def _corr_sql():
    parts = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i:]:
            e = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {e} AS corr FROM telemetry")
            if a != b:
                parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {e} AS corr FROM telemetry")
    return T + "\nUNION ALL\n".join(parts)


@register("agg_correlation_matrix", _corr_sql())
def q_corr(spark, sf):
    return A.correlation_matrix(FX.telemetry(spark, sf), CORR_COLS)


@register("agg_bucket_mean", FT + """
SELECT date_trunc('minute', "timestamp") AS ts_bucket, api_name, avg(error_rate_rolling) AS error_rate_rolling
FROM full_feat GROUP BY 1, 2""")
def q_bucket_mean(spark, sf):
    return cross_api.bucket_mean(feature_table(spark, sf))


@register("agg_pivot_buckets", FT + ", bm2 AS (SELECT date_trunc('minute', \"timestamp\") AS ts_bucket, api_name, "
          "avg(error_rate_rolling) AS v FROM full_feat GROUP BY 1, 2)\nSELECT ts_bucket, " + ", ".join(
              f"first(CASE WHEN api_name = '{a}' THEN v END) FILTER (WHERE api_name = '{a}') AS \"{a}\""
              for a in C.ALL_APIS) + " FROM bm2 GROUP BY ts_bucket")
def q_pivot(spark, sf):
    return cross_api.pivot_buckets(cross_api.bucket_mean(feature_table(spark, sf)))


@register("agg_dedup_first", T + """
SELECT event_id, "timestamp", api_name, user_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, api_name ORDER BY "timestamp", event_id) AS rn FROM telemetry
) WHERE rn = 1""")
def q_dedup(spark, sf):
    t = FX.telemetry(spark, sf).select("event_id", "timestamp", "api_name", "user_id")
    return A.dedup_first(t, keys=("user_id", "api_name"), order=("timestamp", "event_id"))


@register("agg_rt_box_stats", T + """
, q AS (SELECT api_name, count(*) AS n, min(response_time) AS min, max(response_time) AS max,
        quantile_cont(response_time, 0.25) AS q1, quantile_cont(response_time, 0.5) AS median,
        quantile_cont(response_time, 0.75) AS q3 FROM telemetry GROUP BY 1)
SELECT api_name, n, min, q1, median, q3, max, q1 - 1.5 * (q3 - q1) AS lower_fence,
       q3 + 1.5 * (q3 - q1) AS upper_fence FROM q""".replace("\n, q AS", ",\nq AS", 1))
def q_box(spark, sf):
    return A.box_stats(FX.telemetry(spark, sf))


@register("agg_health_metrics", T + f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY api_name ORDER BY "timestamp" DESC, event_id DESC) AS rn FROM telemetry),
tot AS (SELECT api_name, count(*) AS total_requests FROM telemetry GROUP BY 1),
g AS (SELECT api_name, {_cents_avg('response_time')} AS avg_response_time,
             list_sort(list(response_time)) AS rts, avg(1 - success) AS error_rate, count(*) AS window_size
      FROM ranked WHERE rn <= 50 GROUP BY 1)
SELECT api_name, avg_response_time, rts[CAST(floor(len(rts) * 0.95) AS BIGINT) + 1] AS p95_response_time,
       error_rate, total_requests, window_size,
       CASE WHEN error_rate > 0.3 THEN 'unhealthy' ELSE 'healthy' END AS status
FROM g JOIN tot USING (api_name)""".replace("\n, ranked AS", ",\nranked AS", 1))
def q_health(spark, sf):
    return A.health_metrics(FX.telemetry(spark, sf), last_n=50)


@register("agg_cross_check", T + """
, dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, api_name ORDER BY "timestamp", event_id) AS rn
                       FROM telemetry) WHERE rn = 1),
ga AS (SELECT api_name, count(*) AS rows_a, 100.0 * avg(1 - success) AS fail_pct_a FROM telemetry GROUP BY 1),
gb AS (SELECT api_name, count(*) AS rows_b, 100.0 * avg(1 - success) AS fail_pct_b FROM dd GROUP BY 1)
SELECT coalesce(ga.api_name, gb.api_name) AS api_name, coalesce(rows_a, 0) AS rows_a, coalesce(rows_b, 0) AS rows_b,
       coalesce(rows_a, 0) - coalesce(rows_b, 0) AS delta, fail_pct_a, fail_pct_b
FROM ga FULL OUTER JOIN gb ON ga.api_name = gb.api_name""".replace("\n, dd AS", ",\ndd AS", 1))
def q_cross_check(spark, sf):
    t = FX.telemetry(spark, sf)
    return A.cross_check(t, A.dedup_first(t, keys=("user_id", "api_name"), order=("timestamp", "event_id")))


@register("win_boundary_contamination", T + """
, o AS (SELECT data_source, row_number() OVER (ORDER BY api_name, "timestamp", event_id) - 1 AS gidx FROM telemetry),
c AS (SELECT gidx, CASE WHEN lag(data_source) OVER w IS NOT NULL AND lag(data_source) OVER w IS DISTINCT FROM data_source
                    THEN gidx END AS chg FROM o WINDOW w AS (ORDER BY gidx)),
l AS (SELECT gidx, max(chg) OVER (ORDER BY gidx ROWS BETWEEN 28 PRECEDING AND CURRENT ROW) AS lc FROM c)
SELECT count(*) AS total_sequences, coalesce(sum(CASE WHEN lc IS NOT NULL THEN 1 ELSE 0 END), 0) AS broken_sequences,
       100.0 * coalesce(sum(CASE WHEN lc IS NOT NULL THEN 1 ELSE 0 END), 0) / greatest(count(*), 1) AS broken_pct,
       100.0 * coalesce(sum(CASE WHEN lc IS NOT NULL THEN 1 ELSE 0 END), 0) / greatest(count(*), 1) > 1 AS flag
FROM l WHERE gidx >= 29""".replace("\n, o AS", ",\no AS", 1))
def q_boundary(spark, sf):
    return A.boundary_contamination(FX.telemetry(spark, sf))

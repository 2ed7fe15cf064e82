"""Registered queries: feature engineering (WIN-*, JN-04..10, AGG-13/14, SCL-01..03)."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline.operators import features
from faultline.plans import sql as Q
from faultline.plans.catalog import register
from faultline.plans.feature_table import FEATURE_TABLE_COLS, feature_table, flagship
from faultline.sources import fixtures as FX

_COLS = ", ".join(f'"{c}"' if c == "timestamp" else c for c in FEATURE_TABLE_COLS)


@register("feature_table", Q.full_features_with() + f"\nSELECT {_COLS} FROM full_feat")
def q_feature_table(spark, sf_dir):
    return feature_table(spark, sf_dir)


@register("flagship_diagnosis", Q.full_features_with() + f"""
SELECT api_name, category, count(*) AS n_rows, sum(1 - success) AS failures,
       round(avg(1 - success), 6) AS failure_rate, round(avg(confidence), 6) AS avg_confidence
FROM (SELECT *, {Q.diagnose_case()} AS category, {Q.diagnose_confidence()} AS confidence FROM full_feat) d
GROUP BY api_name, category""")
def q_flagship(spark, sf_dir):
    return flagship(spark, sf_dir)


# --- latencies in seconds with five decimals: plain double windows -----------------------------
FINE = ["response_time_rolling_mean", "response_time_rolling_std", "response_time_variance", "error_rate_rolling", "error_volatility",
        "response_time_lag_1", "response_time_lag_5"]


def _fine_sql(n: int, n_vol: int) -> str:
    frame = "(PARTITION BY api_name ORDER BY \"timestamp\", event_id ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
    return "WITH " + FX.telemetry_sql() + f""",
t AS (SELECT event_id, api_name, "timestamp", CAST(response_time AS DOUBLE) / 1000 AS rt, CAST(1 - success AS DOUBLE) AS err FROM telemetry),
w AS (SELECT event_id, avg(rt) OVER f AS m, coalesce(stddev_samp(rt) OVER f, 0) AS s, avg(err) OVER f AS e, coalesce(stddev_samp(err) OVER v, 0) AS ev,
        coalesce(lag(rt, 1) OVER o, avg(rt) OVER (PARTITION BY api_name)) AS l1, coalesce(lag(rt, 5) OVER o, avg(rt) OVER (PARTITION BY api_name)) AS l5
      FROM t WINDOW o AS (PARTITION BY api_name ORDER BY "timestamp", event_id), f AS {frame.format(n - 1)}, v AS {frame.format(n_vol - 1)})
SELECT event_id, round(m, 9) AS response_time_rolling_mean, round(s, 7) AS response_time_rolling_std, round(s * s, 7) AS response_time_variance,
       round(e, 9) AS error_rate_rolling, round(ev, 7) AS error_volatility, round(l1, 9) AS response_time_lag_1, round(l5, 9) AS response_time_lag_5
FROM w"""


def _fine(spark, sf_dir, profile):
    tele = FX.telemetry(spark, sf_dir).withColumn("response_time", F.col("response_time").cast("double") / 1000)
    out = features.series_features(tele, profile)
    digits = {"response_time_rolling_std": 7, "response_time_variance": 7, "error_volatility": 7}
    return out.select("event_id", *[F.round(c, digits.get(c, 9)).alias(c) for c in FINE])


@register("feature_seconds_batch60", _fine_sql(60, 30))
def q_seconds_60(spark, sf_dir):
    from dataclasses import replace
    return _fine(spark, sf_dir, replace(features.PROFILES["batch60"], round_outputs=False))


@register("feature_seconds_batch20", _fine_sql(20, 20))
def q_seconds_20(spark, sf_dir):
    return _fine(spark, sf_dir, "batch20")

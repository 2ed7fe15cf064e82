"""The long scored table every evaluation operator consumes:
(event_id, api_name, timestamp, horizon, p, lower, upper, y, y_type).

Scores come from the deterministic surrogate (ML-26) over the feature table:
error_rate = error_rate_rolling, rt_multiplier, error_volatility,
load = burst_ratio, recent_failures = failures among the previous 20 rows;
y = failure flag h rows ahead in the same API series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from faultline.session import reliable_checkpoint

from faultline.operators import cross_api, features, series, surrogate
from faultline.sources import fixtures

HORIZONS = (1, 5, 15)
RECENT_N = 20


def labelled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-API and cross-API features with the targets of every horizon."""
    tele = fixtures.telemetry(spark, sf_dir)
    f = features.series_features(tele, "batch60", decimals=2, horizons=HORIZONS, recent_n=RECENT_N)
    return cross_api.cross_api_features(reliable_checkpoint(f))


def scored_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.surrogate_forecast(labelled_features(spark, sf_dir))


def scored_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.to_long(scored_wide(spark, sf_dir), HORIZONS)


def chrono_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP-03 support: global chronological position of every event."""
    ev = fixtures.telemetry(spark, sf_dir).select("event_id", "timestamp")
    return series.with_row_index(ev, key=None, order=("timestamp", "event_id"), idx_col="pos")


def chrono_slice(df: DataFrame, positions: DataFrame, n: int, lo: float, hi: float) -> DataFrame:
    """Rows whose chronological position is in [floor(lo*n), floor(hi*n))."""
    a, b = int(lo * n), int(hi * n)
    sel = positions.filter((F.col("pos") >= a) & (F.col("pos") < b)).select("event_id")
    return df.join(sel, "event_id", "left_semi")

"""Composed plans: the telemetry feature table and the flagship diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from faultline.session import reliable_checkpoint

from faultline import constants as C
from faultline.operators import cross_api, decide, features
from faultline.sources import fixtures

FEATURE_TABLE_COLS = (["event_id", "timestamp", "api_name", "status_code", "success",
                       "error_type", "data_source", "is_pre_open", "is_market_close"]
                      + C.FEATURE_COLS)


def feature_table(spark: SparkSession, sf_dir: str, profile: str = "batch60") -> DataFrame:
    """events -> telemetry -> per-API features -> cross-API features (50 cols)."""
    tele = fixtures.telemetry(spark, sf_dir)
    # the per-row features feed both the bucket aggregate and the row join of
    # the cross-API step: materialise them once in the shared checkpoint folder
    # (cuts lineage; concurrent query stages would otherwise each recompute
    # the window pass before a cache is filled)
    f = reliable_checkpoint(features.series_features(tele, profile, decimals=2))
    full = cross_api.cross_api_features(f)
    return full.select(*FEATURE_TABLE_COLS)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature table -> root-cause diagnosis -> (api, category) summary."""
    ft = feature_table(spark, sf_dir)
    d = decide.diagnose(ft)
    return (d.groupBy("api_name", F.col("diagnosis.category").alias("category"))
            .agg(F.count(F.lit(1)).alias("n_rows"),
                 F.sum(F.lit(1) - F.col("success")).alias("failures"),
                 F.round(F.avg(F.lit(1) - F.col("success")), 6).alias("failure_rate"),
                 F.round(F.avg("diagnosis.confidence"), 6).alias("avg_confidence")))

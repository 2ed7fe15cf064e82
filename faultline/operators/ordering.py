"""Whole-table order (TOP-01, TOP-02), the adaptive window (FLT-04), failure filters
(FLT-03) and sequence windows (WIN-22)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.operators import series


def sort_series(df: DataFrame, by=("api_name", "timestamp", "event_id"), out: str = "position") -> DataFrame:
    """TOP-01: ``df`` range-partitioned and sorted by ``by`` (unique), with each row's
    place in the whole table, so that the order outlives the next shuffle."""
    return series.cumulative(df.withColumn("_one", F.lit(1).cast("long")), None, list(by), ["_one"]).withColumn(
        out, F.col("cum__one") - 1).drop("_one", "cum__one")


def latest(df: DataFrame, n: int, order=("timestamp", "event_id")) -> DataFrame:
    """TOP-02: the last ``n`` rows in ``order``; by position, so that ``n`` rows need
    not pass through one task."""
    placed = sort_series(df, order, "_place")
    return placed.where(F.col("_place") >= df.count() - n).drop("_place")


def earliest(df: DataFrame, n: int, order=("timestamp", "event_id")) -> DataFrame:
    """TOP-02: the first ``n`` rows in ``order``."""
    return sort_series(df, order, "_place").where(F.col("_place") < n).drop("_place")


def failures(df: DataFrame, api: str | None = None, error_type: str | None = None) -> DataFrame:
    """FLT-03: failed requests, of one API or error type if given."""
    out = df.where(F.col("success") == 0)
    if api is not None:
        out = out.where(F.col("api_name") == api)
    return out if error_type is None else out.where(F.col("error_type") == error_type)


def adaptive_window(df: DataFrame, n: int, min_rate: float = 0.05, cutoff: str = "2025-01-01", order=("timestamp", "event_id")) -> DataFrame:
    """FLT-04: the last ``n`` rows; if fewer than ``min_rate`` of them failed, the
    last ``n`` rows before ``cutoff`` instead."""
    last = latest(df, n, order)
    rate = last.agg(F.avg(F.lit(1.0) - F.col("success"))).first()[0]
    if rate is not None and rate >= min_rate:
        return last
    return latest(df.where(F.col(order[0]) < F.lit(cutoff).cast("timestamp_ntz")), n, order)


def sequences(df: DataFrame, cols, length: int = 30, step: int = 1, horizons=(), key: str = "api_name",
              order=("timestamp", "event_id")) -> DataFrame:
    """WIN-22: every full window of ``length`` rows of a series (each ``step`` rows)
    as ``window``, an array of rows of ``cols`` as doubles, oldest first, at its last
    row; with ``horizons`` also whether the row that far after the window fails (null
    past the end).  Windows run in blocks with a halo, so a hot series is spread over
    many tasks and a task holds ``length`` rows a window."""
    idx = series.with_row_index(df, key=key, order=order)
    b = series.blocked(idx, block=4096, back=length - 1, fwd=max(horizons, default=0))
    w = series.block_window(key)
    rows = F.collect_list(F.array(*[F.col(c).cast("double") for c in cols])).over(w.rowsBetween(-(length - 1), 0))
    target = [F.lead((F.lit(1) - F.col("success")).cast("int"), h).over(w).alias(f"y_h{h}") for h in horizons]
    first = F.col("row_idx") - (length - 1)
    return (b.select(*[c for c in dict.fromkeys(["event_id", key, "row_idx"])], "_home", rows.alias("window"), *target)
            .where("_home").where((first >= 0) & (first % step == 0)).drop("_home"))

"""Joins and lookups (JN-*) that attach reference data to telemetry.

Calendars and maps are small fixed lists; they are compiled to CASE / map
expressions (no shuffle, no join) or broadcast after a size check.  Joins of
two large inputs (anti joins, upserts) are left to the planner (sort-merge,
AQE skew handling).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.operators import series
from faultline.session import broadcast_if_small


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- JN-06 --------------------------------------------------------------------------
def flag_holidays(df: DataFrame, ts="timestamp", holidays=C.HOLIDAYS, match: str = "date",
                  out: str = "is_holiday") -> DataFrame:
    """Semi-join against a fixed holiday list (InSet, evaluated in codegen)."""
    d = F.to_date(_c(ts))
    if match == "month_day":
        keys = sorted({h[5:] for h in holidays})
        flag = F.date_format(d, "MM-dd").isin(*keys)
    else:
        flag = d.isin(*[F.lit(h).cast("date") for h in holidays])
    return df.withColumn(out, flag.cast("int"))


# --- JN-04 / JN-05 -------------------------------------------------------------------
def _event_case(ts: Column, events, idx: int, default):
    """Later entries override earlier ones: evaluate from the last entry back."""
    expr = None
    for ev in reversed(events):
        cond = (ts >= F.lit(ev[1]).cast("timestamp_ntz")) & (ts <= F.lit(ev[2]).cast("timestamp_ntz"))
        val = F.lit(ev[idx])
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def tag_events(df: DataFrame, calendar=C.GLOBAL_EVENTS, ts="timestamp",
               prefix: str = "") -> DataFrame:
    """Interval join to an event calendar; ``start <= ts <= end`` where end is
    midnight of the end date; the last matching entry wins."""
    t = _c(ts).cast("timestamp_ntz")
    return df.select(
        "*",
        _event_case(t, calendar, 0, "normal").alias(f"{prefix}event_label"),
        _event_case(t, calendar, 3, 0.0).cast("double").alias(f"{prefix}error_rate_boost"),
        _event_case(t, calendar, 4, 1.0).cast("double").alias(f"{prefix}rt_multiplier"),
    )


def combine_event_tags(df: DataFrame, global_cal=C.GLOBAL_EVENTS,
                       api_cal=C.API_SPECIFIC_EVENTS, ts="timestamp", api="api_name") -> DataFrame:
    """Global + API-specific calendars: boost=max, rt_mult=max, label = API
    specific unless 'normal'; error probability clip(base+boost, 0, .97)."""
    g = tag_events(df, global_cal, ts, prefix="_g_")
    t = _c(ts).cast("timestamp_ntz")
    a_label = F.lit("normal")
    a_boost = F.lit(0.0)
    a_mult = F.lit(1.0)
    lab, bst, mlt = None, None, None
    for name, evs in api_cal.items():
        is_api = F.col(api) == name
        lab = (F.when(is_api, _event_case(t, evs, 0, "normal")) if lab is None
               else lab.when(is_api, _event_case(t, evs, 0, "normal")))
        bst = (F.when(is_api, _event_case(t, evs, 3, 0.0)) if bst is None
               else bst.when(is_api, _event_case(t, evs, 3, 0.0)))
        mlt = (F.when(is_api, _event_case(t, evs, 4, 1.0)) if mlt is None
               else mlt.when(is_api, _event_case(t, evs, 4, 1.0)))
    if lab is not None:
        a_label, a_boost, a_mult = lab.otherwise("normal"), bst.otherwise(0.0), mlt.otherwise(1.0)
    out = g.select(
        *[c for c in df.columns],
        F.when(a_label != "normal", a_label).otherwise(F.col("_g_event_label")).alias("event_label"),
        F.greatest(F.col("_g_error_rate_boost"), a_boost.cast("double")).alias("error_rate_boost"),
        F.greatest(F.col("_g_rt_multiplier"), a_mult.cast("double")).alias("rt_multiplier"),
    )
    return out


def error_probability(base: Column, boost: Column) -> Column:
    return F.least(F.greatest(base + boost, F.lit(0.0)), F.lit(0.97))


# --- JN-07 ---------------------------------------------------------------------------
def apply_map(df: DataFrame, col: str, mapping: dict, default=None, out: str | None = None) -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    v = F.element_at(m, F.col(col))
    if default is not None:
        v = F.coalesce(v, F.lit(default))
    return df.withColumn(out or col, v)


# --- JN-01 ---------------------------------------------------------------------------
def attach(df: DataFrame, features: DataFrame, on=("ts_bucket", "api_name")) -> DataFrame:
    return df.join(features, list(on), "left")


# --- JN-02 / JN-03 / SET-02 / SET-04 ---------------------------------------------------
def new_rows(df: DataFrame, existing: DataFrame, keys=("api_name", "timestamp")) -> DataFrame:
    """Rows of ``df`` whose composite key is not in ``existing`` (left anti)."""
    return df.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def replace_overlap(existing: DataFrame, batch: DataFrame, on: str = "timestamp") -> DataFrame:
    """Upsert: drop existing rows whose ``on`` value occurs in the batch, then
    union the batch (by name, missing columns null)."""
    kept = existing.join(batch.select(on).distinct(), on, "left_anti")
    return kept.unionByName(batch, allowMissingColumns=True)


# --- JN-11 / JN-12 -------------------------------------------------------------------------
def least_risk_backup(rates: DataFrame, api: str = "api_name", rate: str = "failure_rate",
                      order: list | None = None) -> DataFrame:
    """For each API, the other API with the lowest measured rate (ties by
    input order).  ``rates`` has one row per API (bounded); the others are
    found by exploding the collected list, not by a cross join."""
    order = order or C.ALL_APIS
    pos = F.array_position(F.array(*[F.lit(a) for a in order]), F.col(api))
    w = Window.partitionBy(F.lit(1))
    lst = F.collect_list(F.struct(F.col(rate).alias("r"), pos.alias("p"), F.col(api).alias("a"))).over(w)
    cands = F.filter(lst, lambda s: s["a"] != F.col(api))
    best = F.array_min(cands)
    return rates.select(F.col(api), F.col(rate),
                        best["a"].alias("backup_api"), best["r"].alias("backup_rate"))


def fixed_backup(rates: DataFrame, backup_map=C.BACKUP_API, api: str = "api_name",
                 rate: str = "failure_rate") -> DataFrame:
    m = F.create_map(*[F.lit(x) for kv in backup_map.items() for x in kv])
    b = rates.select(F.col(api).alias("backup_api"), F.col(rate).alias("backup_rate"))
    return (rates.withColumn("backup_api", F.element_at(m, F.col(api)))
            .join(F.broadcast(b), "backup_api", "left")
            .select(api, rate, "backup_api", "backup_rate"))


# --- JN-13 ---------------------------------------------------------------------------
def flag_anomalies(df: DataFrame, labels: DataFrame, file_col="file", ts_col="ts_str") -> DataFrame:
    """Anomaly flag iff (file, timestamp string) appears in the label set."""
    lab = labels.select(F.col(file_col), F.col(ts_col), F.lit(1).alias("_hit")).distinct()
    return (df.join(lab, [file_col, ts_col], "left")
            .withColumn("is_anomaly", F.coalesce(F.col("_hit"), F.lit(0))).drop("_hit"))


# --- JN-14 ---------------------------------------------------------------------------
def align_targets(df: DataFrame, horizons=(1, 5, 15), key="api_name", order=("timestamp", "event_id"),
                  length: int = 1) -> DataFrame:
    """Failure flag ``length+h-1`` rows after each row of its series, null past the
    end; inside halo blocks, so that a hot series is spread over many tasks."""
    far = length + max(horizons) - 1
    b = series.blocked(series.with_row_index(df, key=key, order=order, idx_col="_pos"), "_pos", max(4096, far), fwd=far)
    w = Window.partitionBy(key, "_blk").orderBy("_pos")
    out = b.withColumns({f"y_h{h}": F.lead(F.lit(1) - F.col("success"), length + h - 1).over(w) for h in horizons})
    return out.where("_home").drop("_pos", "_blk", "_home")


# --- JN-15 ----------------------------------------------------------------------------
def compare_metrics(old: DataFrame, new: DataFrame, on: str = "horizon", metric: str = "auc") -> DataFrame:
    return (old.select(on, F.col(metric).alias(f"old_{metric}"))
            .join(new.select(on, F.col(metric).alias(f"new_{metric}")), on, "full_outer")
            .withColumn("delta", F.col(f"new_{metric}") - F.col(f"old_{metric}")))

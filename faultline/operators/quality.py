"""Data quality, cleaning and drift (FLT-06, PRJ-05, DQ-01..03, DR-01..06, DR-09..11).

KS statistics are computed exactly and distributed: both samples are reduced
to per-(feature, value) counts, cumulative counts come from the range-
partitioned prefix scan, and D = max |F_a - F_b| is a plain aggregate.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from faultline import constants as C
from faultline.operators import aggregates as A
from faultline.operators import sampling, series
from faultline.operators.joins import new_rows


# --- FLT-06 / PRJ-05 ------------------------------------------------------------------------
def null_like(col: str) -> Column:
    """null, blank after strip, or 'unknown' (lower-cased, not stripped)."""
    c = F.col(col)
    return c.isNull() | (F.trim(c.cast("string")) == "") | (F.lower(c.cast("string")) == "unknown")


def repair_error_type(df: DataFrame, col: str = "error_type", backfill: str = "failure_event",
                      defaults=C.DEFAULT_FAILURE_TYPE) -> DataFrame:
    """Failure rows: backfill from ``failure_event`` (if present), then the
    per-API default; success rows with a null-like type -> 'none'."""
    m = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    fail = F.col("success") == 0
    cur = F.col(col)
    if backfill in df.columns:
        cur = F.when(null_like(col) & fail & F.col(backfill).isNotNull(), F.col(backfill)).otherwise(cur)
    t = df.withColumn(col, cur)
    t = t.withColumn(col, F.when(null_like(col) & fail,
                                 F.coalesce(F.element_at(m, F.col("api_name")), F.col(col))).otherwise(F.col(col)))
    return t.withColumn(col, F.when(null_like(col) & ~fail, F.lit("none")).otherwise(F.col(col)))


def repair_counts(df: DataFrame, col: str = "error_type", defaults=C.DEFAULT_FAILURE_TYPE) -> DataFrame:
    """Counts at each repair step (null-like before, mapped, set to 'none')."""
    fail = F.col("success") == 0
    mapped = fail & F.col("api_name").isin(*defaults.keys())
    return df.agg(F.sum(null_like(col).cast("int")).alias("null_before"),
                  F.sum((null_like(col) & mapped).cast("int")).alias("mapping_filled"),
                  F.sum((null_like(col) & ~fail).cast("int")).alias("set_none"),
                  F.sum((null_like(col) & fail & ~mapped).cast("int")).alias("null_after"))


# --- DQ-02 / DQ-03 -----------------------------------------------------------------------------
def clean(csv: DataFrame, db: DataFrame, cap_apis=("transaction_api",), cap: float = 0.25,
          source_label: str = "db_extended") -> DataFrame:
    """dedup(db) -> anti join vs csv on (api, ts) -> tag source -> union ->
    repair error types -> cap the share of each listed API (in order)."""
    keys = ["api_name", "timestamp"] + (["data_source"] if "data_source" in db.columns else [])
    db1 = A.dedup_first(db, keys, ("event_id",))
    new = new_rows(db1, csv, ("api_name", "timestamp"))
    new = new.withColumn("data_source", F.coalesce(F.col("data_source"), F.lit(source_label))) \
        if "data_source" in new.columns else new.withColumn("data_source", F.lit(source_label))
    base = csv if "data_source" in csv.columns else csv.withColumn("data_source", F.lit("synthetic"))
    merged = base.unionByName(new, allowMissingColumns=True)
    merged = repair_error_type(merged)
    for api in cap_apis:
        merged = sampling.cap_group_share(merged, api, cap)
    return merged


def cleaning_report(steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """DQ-03: one row per step with its row count and failure count."""
    out = None
    for i, (name, df) in enumerate(steps):
        r = df.agg(F.count(F.lit(1)).alias("rows"),
                   F.sum(F.when(F.col("success") == 0, 1).otherwise(0)).alias("failures")) \
            .select(F.lit(i).alias("step_no"), F.lit(name).alias("step"), "rows", "failures")
        out = r if out is None else out.unionByName(r)
    return out


def audit(df: DataFrame, source: str = "data_source") -> DataFrame:
    """DQ-01: recommended actions from the source / coverage / failure-mode /
    boundary reports (one row per action)."""
    sb = A.source_breakdown(df, source)
    acts = [sb.filter("flag_low").select(F.lit("DROP").alias("action"), "source",
                                         F.lit("rows below the low-share threshold").alias("reason")),
            sb.filter("flag_dominant").select(F.lit("DOWNSAMPLE").alias("action"), "source",
                                              F.lit("source dominates the table").alias("reason"))]
    present = [f for f in C.AUDIT_KEY_FEATURES if f in df.columns]
    if present:
        cov = A.feature_coverage(df, present, source)
        acts.append(cov.filter("flag_low_coverage").select(
            F.lit("DROP").alias("action"), "source",
            F.lit("3+ key features under the coverage threshold").alias("reason")).distinct())
    fm = A.failure_modes(df, source)
    acts.append(fm.filter("flag_low_rate").select(F.lit("CONSIDER DROPPING").alias("action"), "source",
                                                  F.lit("low failure rate").alias("reason")).distinct())
    acts.append(fm.filter("flag_dominant").select(F.lit("REVIEW").alias("action"), "source",
                                                  F.lit("single failure mode dominates").alias("reason")).distinct())
    bc = A.boundary_contamination(df, source)
    acts.append(bc.filter("flag").select(F.lit("FIX BOUNDARY").alias("action"), F.lit(None).cast("string")
                                         .alias("source"), F.lit("sequences cross source boundaries").alias("reason")))
    out = acts[0]
    for a in acts[1:]:
        out = out.unionByName(a)
    return out


# --- KS two-sample -------------------------------------------------------------------------------
def ks_pvalue(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic Kolmogorov p-value: 2 sum_j (-1)^(j-1) exp(-2 j^2 lam^2),
    lam = (sqrt(en) + 0.12 + 0.11/sqrt(en)) * D, en = n*m/(n+m); clipped to [0,1]."""
    en = n.cast("double") * m.cast("double") / (n + m).cast("double")
    lam = (F.sqrt(en) + F.lit(0.12) + F.lit(0.11) / F.sqrt(en)) * d
    s = F.lit(0.0)
    for j in range(1, terms + 1):
        s = s + F.lit(2.0 * (-1) ** (j - 1)) * F.exp(F.lit(-2.0 * j * j) * lam * lam)
    return F.when(d <= 0, F.lit(1.0)).otherwise(F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))


EXACT_MAX = 10_000  # samples up to this size get the exact p-value


def exact_ks_p(n: int, m: int, gap: int) -> float:
    """P(sup |F_a - F_b| >= gap / (n m)) for two samples of one distribution, without
    ties: the share of all orders of n a's and m b's whose lattice path reaches
    |i m - j n| >= gap.  Paths are followed step by step as probabilities of their
    numbers of a's; what reaches the bound is taken out and summed, so that small
    p-values keep their digits and nothing overflows."""
    if gap <= 0:
        return 1.0
    i = np.arange(n + 1)
    mass = np.zeros(n + 1)
    mass[0], out = 1.0, 0.0
    for k in range(n + m):
        j = k - i
        to_a = mass * (n - i) / (n + m - k)
        mass = mass * np.clip(m - j, 0, None) / (n + m - k)
        mass[1:] += to_a[:-1]
        hit = np.abs(i * m - (k + 1 - i) * n) >= gap
        out += mass[hit].sum()
        mass[hit] = 0.0
    return float(min(out, 1.0))


def _exact_p(n: pd.Series, m: pd.Series, gap: pd.Series) -> pd.Series:
    return pd.Series([exact_ks_p(int(x), int(y), int(g)) if max(x, y) <= EXACT_MAX else None for x, y, g in zip(n, m, gap)], dtype="float64")


def ks_2samp(a: DataFrame, b: DataFrame, feats, by=(), exact: bool = False) -> DataFrame:
    """DR-02: per (by..., feature): ks = sup |F_a - F_b|, n_a, n_b, p-value; with
    ``exact`` the p-value of samples up to ``EXACT_MAX`` is counted, not asymptotic."""
    by = list(by)

    def long(df, side):
        cols = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in feats]
        return (df.select(*by, F.explode(F.array(*cols)).alias("_r")).select(*by, "_r.*")
                .filter(F.col("value").isNotNull() & ~F.isnan("value"))
                .withColumn("ca", F.lit(1 if side == "a" else 0)).withColumn("cb", F.lit(1 if side == "b" else 0)))
    u = long(a, "a").unionByName(long(b, "b"))
    cnt = u.groupBy(*by, "feature", "value").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    tot = cnt.groupBy(*by, "feature").agg(F.sum("ca").alias("na"), F.sum("cb").alias("nb"))
    cum = series.cumulative(cnt, [*by, "feature"], ["value"], ["ca", "cb"])
    j = cum.join(F.broadcast(tot), [*by, "feature"])
    diff = F.abs(F.col("cum_ca") / F.col("na") - F.col("cum_cb") / F.col("nb"))
    g = j.groupBy(*by, "feature").agg(F.max(diff).alias("ks"), F.first("na").alias("n_a"),
                                      F.first("nb").alias("n_b"))
    far = ks_pvalue(F.col("ks"), F.col("n_a"), F.col("n_b"))
    if not exact:
        return g.withColumn("p_value", far)
    gap = F.round(F.col("ks") * F.col("n_a") * F.col("n_b")).cast("long")  # a whole number but for rounding
    g = g.where((F.col("n_a") > 0) & (F.col("n_b") > 0))
    return g.withColumn("p_value", F.coalesce(F.pandas_udf(_exact_p, DoubleType())("n_a", "n_b", gap), far))


def drift_decision(ks: DataFrame, ks_thr: float = C.KS_THRESHOLD, p_thr: float = C.KS_P_THRESHOLD,
                   min_features: int = C.DRIFT_MIN_FEATURES, by=()) -> DataFrame:
    """DR-03: feature drifted iff ks > thr and p < thr; dataset drift iff at
    least ``min_features`` drifted."""
    f = ks.withColumn("drifted", (F.col("ks") > ks_thr) & (F.col("p_value") < p_thr))
    g = f.groupBy(*by).agg(F.sum(F.col("drifted").cast("int")).alias("n_drifted"),
                           F.count(F.lit(1)).alias("n_features"))
    return g.withColumn("dataset_drift", F.col("n_drifted") >= min_features)


def drift_baseline(df: DataFrame, feats=C.DRIFT_FEATURES, n: int = 5000, seed="baseline",
                   id_col: str = "event_id") -> DataFrame:
    """DR-01: at most n sampled rows (hash order), as a long (feature, value) table."""
    s = sampling.sample_n(df.select(id_col, *feats), n, seed, id_col)
    cols = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in feats]
    return s.select(id_col, F.explode(F.array(*cols)).alias("_r")).select(id_col, "_r.*")


def baseline_state(df: DataFrame, feats, time_col: str = "timestamp") -> DataFrame:
    """DR-01 over all rows: per day, feature and value how often the value occurs.
    States of other rows are merged by adding, so a baseline is kept as a table to
    which each batch appends its own state.  Nulls and NaN are left out."""
    cols = [F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in feats]
    rows = df.select(F.to_date(time_col).alias("day"), F.explode(F.array(*cols)).alias("_r")).select("day", "_r.*")
    rows = rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.groupBy("day", "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def merge_states(states: DataFrame) -> DataFrame:
    """(feature, value, n) of all states together."""
    return states.groupBy("feature", "value").agg(F.sum("n").alias("n"))


def state_summary(counts: DataFrame, probs=(0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Per feature: rows, distinct values, bounds and exact quantiles (the least value
    with at least that share of the rows at or below it) of merged counts."""
    cum = series.cumulative(counts, ["feature"], ["value"], ["n"])
    tot = counts.groupBy("feature").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"),
                                        F.min("value").alias("lo"), F.max("value").alias("hi"))
    at = [F.min(F.when(F.col("cum_n") >= F.ceil(F.lit(p) * F.col("n_rows")), F.col("value"))).alias(f"q{round(p * 100)}") for p in probs]
    # one row a feature
    return cum.join(F.broadcast(tot), "feature").groupBy("feature", "n_rows", "n_distinct", "lo", "hi").agg(*at)


def ks_counts(a: DataFrame, b: DataFrame) -> DataFrame:
    """DR-02 between two merged states: per feature ks, n_a, n_b and the p-value."""
    zero = F.lit(0).cast("long")
    u = a.select("feature", "value", F.col("n").alias("ca"), zero.alias("cb")).unionByName(
        b.select("feature", "value", zero.alias("ca"), F.col("n").alias("cb")))
    cnt = u.groupBy("feature", "value").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    tot = cnt.groupBy("feature").agg(F.sum("ca").alias("n_a"), F.sum("cb").alias("n_b"))
    cum = series.cumulative(cnt, ["feature"], ["value"], ["ca", "cb"])
    gap = F.abs(F.col("cum_ca") / F.col("n_a") - F.col("cum_cb") / F.col("n_b"))
    g = cum.join(F.broadcast(tot), "feature").groupBy("feature", "n_a", "n_b").agg(F.max(gap).alias("ks"))
    return g.withColumn("p_value", ks_pvalue(F.col("ks"), F.col("n_a"), F.col("n_b")))


def imbalance(df: DataFrame, thresh: float = C.IMBALANCE_FLOOR) -> DataFrame:
    """DR-05: failure rate and the imbalance flag."""
    return df.agg((F.lit(1.0) - F.avg(F.coalesce(F.col("success"), F.lit(1)))).alias("failure_rate")) \
        .withColumn("imbalance", F.col("failure_rate") < thresh)


def slo_budget(df: DataFrame, coverage: str = "coverage", target: float = 0.90, days: int = 29) -> DataFrame:
    """DR-10: consumed = clip((1-cov)/(1-target), 0, 1.25); remaining;
    daily burn = consumed/days; fast-burn flag when burn > 1/days * 2."""
    consumed = F.least(F.greatest((F.lit(1.0) - F.col(coverage)) / F.lit(1.0 - target), F.lit(0.0)), F.lit(1.25))
    burn = consumed / F.lit(float(days))
    return df.select("*", consumed.alias("budget_consumed"),
                     (F.lit(1.0) - consumed).alias("budget_remaining"), burn.alias("daily_burn"),
                     (burn > F.lit(2.0 / days)).alias("fast_burn"))


def heal_records(ks: DataFrame, decision: DataFrame, run_col: str = "run") -> DataFrame:
    """Nested heal-log records (one per run) with a
    map<feature, struct<ks, p, drifted>> drift report (the SRC-08 schema)."""
    f = ks.withColumn("drifted", (F.col("ks") > C.KS_THRESHOLD) & (F.col("p_value") < C.KS_P_THRESHOLD))
    rep = f.groupBy(run_col).agg(F.map_from_entries(F.collect_list(F.struct(
        "feature", F.struct(F.col("ks"), F.col("p_value").alias("p"), F.col("drifted"))))).alias("drift_report"))
    return rep.join(decision.select(run_col, "dataset_drift", "n_drifted"), run_col)


def drift_timeline(log: DataFrame, run_col: str = "run") -> DataFrame:
    """DR-09: per run and signal: ks, p, drifted (exploded drift map)."""
    return log.select(run_col, F.explode("drift_report").alias("signal", "r")).select(
        run_col, "signal", F.col("r.ks").alias("ks"), F.col("r.p").alias("p"), F.col("r.drifted").alias("drifted"))

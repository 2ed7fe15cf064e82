"""Aggregations (AGG-01..19) and audit reports.

All are hash aggregations with map-side partial aggregation; shares and
flags are computed from the small aggregated result, with grand totals as
scalar subqueries.  Money-like or
2-decimal averages use exact integer sums so every engine returns the same
double.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.scalars import np_round
from faultline.session import broadcast_if_small


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fail() -> Column:
    return (F.lit(1) - F.col("success")).cast("int")


def exact_avg(col) -> Column:
    """Mean from an exact integer sum of billionths: the same in any order."""
    c = _c(col)
    return (F.sum(F.round(c * F.lit(1e9)).cast("decimal(28,0)")).cast("double")
            / (F.count(c) * F.lit(1e9)))


def daily_summary(df: DataFrame) -> DataFrame:
    """AGG-01: per (date, api, event_label)."""
    # the day is reported as an ISO string (portable across engines/clients)
    return (df.groupBy(F.to_date("timestamp").cast("string").alias("date"), "api_name", "event_label")
            .agg(F.count(F.lit(1)).alias("total_requests"),
                 F.sum(fail()).alias("total_failures"),
                 np_round(F.avg(fail()), 4).alias("failure_rate"),
                 np_round(exact_avg("response_time"), 2).alias("avg_response_time_ms"),
                 np_round(F.max("response_time"), 2).alias("max_response_time_ms")))


def event_impact(df: DataFrame) -> DataFrame:
    """AGG-02: non-normal events by (event, api)."""
    return (df.filter(F.col("event_label") != "normal")
            .groupBy("event_label", "api_name")
            .agg(F.count(F.lit(1)).alias("affected_rows"),
                 np_round(F.avg(fail()), 4).alias("failure_rate"),
                 np_round(exact_avg("response_time"), 2).alias("avg_response_time_ms"),
                 np_round(F.sum(F.round(F.col("error_rate_boost") * 100).cast("long")).cast("double")
                          / (F.count(F.lit(1)) * F.lit(100.0)), 4).alias("avg_error_boost"),
                 F.min("timestamp").alias("event_start"),
                 F.max("timestamp").alias("event_end")))


def event_distribution(df: DataFrame) -> DataFrame:
    """AGG-03: by event label (normal excluded)."""
    return (df.filter(F.col("event_label") != "normal").groupBy("event_label")
            .agg(F.count(F.lit(1)).alias("rows"),
                 F.avg(fail()).alias("failure_rate"),
                 exact_avg("response_time").alias("avg_rt")))


def failure_rate(df: DataFrame, by=("api_name",)) -> DataFrame:
    """AGG-04: 1 - mean(success) per group."""
    return df.groupBy(*by).agg((F.lit(1.0) - F.avg("success")).alias("failure_rate"),
                               F.count(F.lit(1)).alias("n"))


def source_breakdown(df: DataFrame, source: str = "data_source", low: float = C.AUDIT_SOURCE_LOW_PCT,
                     high: float = C.AUDIT_SOURCE_HIGH_PCT) -> DataFrame:
    """AGG-05: rows and share per source with LOW/DOMINANT flags."""
    total = df.select(F.count(F.lit(1))).scalar()
    g = df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    pct = F.lit(100.0) * F.col("rows") / total
    return g.select("source", "rows", pct.alias("pct"),
                    (pct < low).alias("flag_low"), (pct > high).alias("flag_dominant"))


def feature_coverage(df: DataFrame, feats=C.AUDIT_KEY_FEATURES, source: str = "data_source",
                     thresh: float = C.AUDIT_COVERAGE_PCT) -> DataFrame:
    """AGG-06: % non-null & non-zero per (source, feature), long form, with the
    per-source count of features under the threshold."""
    present = [f for f in feats if f in df.columns]
    aggs = [(F.lit(100.0) * F.sum(F.when(F.col(f).isNotNull() & (F.col(f) != 0), 1).otherwise(0))
             / F.greatest(F.count(F.lit(1)), F.lit(1))).alias(f) for f in present]
    wide = df.groupBy(F.col(source).alias("source")).agg(*aggs)
    stack = ", ".join(f"'{f}', `{f}`" for f in present)
    long = wide.selectExpr("source", f"stack({len(present)}, {stack}) AS (feature, coverage_pct)")
    w = Window.partitionBy("source")
    low = F.sum(F.when(F.col("coverage_pct") < thresh, 1).otherwise(0)).over(w)
    return long.select("source", "feature", "coverage_pct", low.alias("n_low"),
                       (low >= 3).alias("flag_low_coverage"))


def failure_modes(df: DataFrame, source: str = "data_source", mode: str = "error_type",
                  dom: float = C.AUDIT_DOMINANT_MODE_PCT,
                  min_rate: float = C.AUDIT_FAILURE_MIN_PCT) -> DataFrame:
    """AGG-07: failures by (source, error_type incl. null) as % of the source's
    failures; dominant-mode and low-failure-rate flags."""
    per_src = df.groupBy(F.col(source).alias("source")).agg(
        F.count(F.lit(1)).alias("n_total"), F.sum(fail()).alias("n_failures"))
    modes = (df.filter(F.col("success") == 0)
             .groupBy(F.col(source).alias("source"), F.col(mode).alias("mode"))
             .agg(F.count(F.lit(1)).alias("count")))
    j = modes.join(per_src, "source")
    mode_pct = F.lit(100.0) * F.col("count") / F.col("n_failures")
    rate = F.lit(100.0) * F.col("n_failures") / F.greatest(F.col("n_total"), F.lit(1))
    return j.select("source", "mode", "count", mode_pct.alias("mode_pct"),
                    rate.alias("source_failure_pct"),
                    (mode_pct > dom).alias("flag_dominant"), (rate < min_rate).alias("flag_low_rate"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """AGG-08: frequency table, nulls kept as their own group."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def dataset_stats(df: DataFrame) -> DataFrame:
    """AGG-09: rows, failure rate (null success -> success), APIs, date range."""
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  (F.lit(1.0) - F.avg(F.coalesce(F.col("success"), F.lit(1)))).alias("failure_rate"),
                  F.count_distinct("api_name").alias("n_apis"),
                  F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"))


def feature_profile(df: DataFrame, cols) -> DataFrame:
    """AGG-10: per feature mean, std, min, max, NaN/null count, non-zero %
    (one pass: all aggregates in one ``agg``, then unpivot)."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__mean"), F.stddev_samp(x).alias(f"{c}__std"),
                 F.min(x).alias(f"{c}__min"), F.max(x).alias(f"{c}__max"),
                 F.sum(F.when(x.isNull() | F.isnan(x), 1).otherwise(0)).alias(f"{c}__nan"),
                 (F.lit(100.0) * F.avg(F.when(x != 0, 1).otherwise(0))).alias(f"{c}__nonzero_pct")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}__mean`").alias("mean"),
                     F.col(f"`{c}__std`").alias("std"), F.col(f"`{c}__min`").alias("min"),
                     F.col(f"`{c}__max`").alias("max"), F.col(f"`{c}__nan`").alias("nan_count"),
                     F.col(f"`{c}__nonzero_pct`").alias("nonzero_pct")) for c in cols]
    out = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("warn_sparse", F.col("nonzero_pct") < 10)


def missing_values(df: DataFrame) -> DataFrame:
    """AGG-11: null count per column (one pass, unpivoted)."""
    cols = df.columns
    wide = df.agg(*[F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).alias(c) for c in cols])
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("long").alias("nulls")) for c in cols
    ])).alias("r")).select("r.*")


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """AGG-12: Pearson correlation of every column pair (long form), all pairs
    in one aggregation pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}__{b}")
                    for a, b in pairs])
    rows = []
    for a, b in pairs:
        rows.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                             F.col(f"`{a}__{b}`").alias("corr")))
        if a != b:
            rows.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"),
                                 F.col(f"`{a}__{b}`").alias("corr")))
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def dedup_first(df: DataFrame, keys=("api_name", "timestamp"), order=("event_id",)) -> DataFrame:
    """AGG-15: keep the first row per key by an explicit order (deterministic,
    unlike ``dropDuplicates``)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def duplicate_report(df: DataFrame, keys=("api_name", "timestamp")) -> DataFrame:
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.count(F.lit(1)).alias("distinct_keys"),
                 F.sum(F.col("n") - 1).alias("duplicates"))


def exact_quantiles(df: DataFrame, value: str, probs, by: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy 'linear' = SQL quantile_cont)
    of all groups in one pass: running counts over the distinct values of each
    group (``series.cumulative`` splits a group over many tasks) show which value
    holds which rank."""
    from faultline.operators import series
    if by is None:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), value, probs, "_all").drop("_all")
    keys = [by]
    c = series.value_counts(df.select(*keys, F.col(value).cast("double").alias("_v")), "_v", *keys)
    cum = series.cumulative(c, keys, ["_v"], ["_c"])
    size = broadcast_if_small(c.groupBy(*keys).agg(F.sum("_c").alias("_n")))
    on = cum.join(size.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    at = {}
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        low = F.floor(h)
        for name, rank in (("lo", low), ("hi", F.least(low + 1, F.col("_n") - 1))):
            at[f"{name}{i}"] = F.max(F.when((rank >= F.col("cum__c") - F.col("_c")) & (rank < F.col("cum__c")), F.col("_v")))
        at[f"w{i}"] = F.max(h - low)
    g = on.groupBy(*keys).agg(*[e.alias(n) for n, e in at.items()])
    return g.select(*keys, *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"w{i}")).alias(f"q{i}") for i in range(len(probs))])


def box_stats(df: DataFrame, value: str = "response_time", by: str = "api_name") -> DataFrame:
    """AGG-16: exact quartiles (linear interpolation) and 1.5·IQR whiskers."""
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], by)
    g = df.groupBy(by).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count(F.lit(1)).alias("n"))
    q1, med, q3 = F.col("q0"), F.col("q1"), F.col("q2")
    iqr = q3 - q1
    return g.join(q, by).select(
        by, "n", "min", q1.alias("q1"), med.alias("median"), q3.alias("q3"), "max",
        (q1 - F.lit(1.5) * iqr).alias("lower_fence"), (q3 + F.lit(1.5) * iqr).alias("upper_fence"))


def health_metrics(df: DataFrame, last_n: int = 50, key: str = "api_name",
                   order=("timestamp", "event_id"), unhealthy: float = 0.3) -> DataFrame:
    """AGG-17: over each key's last N requests: avg rt, index p95
    (sorted[int(.95 n)]), error rate, totals, healthy/unhealthy.

    The last-N filter is a top-N per key (row_number over key ordered desc);
    the per-key array is bounded by N.
    """
    w = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    recent = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= last_n)
    tot = df.groupBy(key).agg(F.count(F.lit(1)).alias("total_requests"))
    g = recent.groupBy(key).agg(
        exact_avg("response_time").alias("avg_response_time"),
        F.array_sort(F.collect_list("response_time")).alias("_rts"),
        F.avg(fail()).alias("error_rate"),
        F.count(F.lit(1)).alias("window_size"))
    p95 = F.element_at(F.col("_rts"), (F.floor(F.size("_rts") * F.lit(0.95)) + 1).cast("int"))
    return (g.join(tot, key)
            .select(key, "avg_response_time", p95.alias("p95_response_time"), "error_rate",
                    "total_requests", "window_size",
                    F.when(F.col("error_rate") > unhealthy, "unhealthy").otherwise("healthy").alias("status")))


def cross_check(a: DataFrame, b: DataFrame, by: str = "api_name") -> DataFrame:
    """AGG-18: per-key counts in two tables, delta, failure % of each."""
    ga = a.groupBy(by).agg(F.count(F.lit(1)).alias("rows_a"),
                           (F.lit(100.0) * F.avg(fail())).alias("fail_pct_a"))
    gb = b.groupBy(by).agg(F.count(F.lit(1)).alias("rows_b"),
                           (F.lit(100.0) * F.avg(fail())).alias("fail_pct_b"))
    j = ga.join(gb, by, "full_outer")
    return j.select(by, F.coalesce("rows_a", F.lit(0)).alias("rows_a"),
                    F.coalesce("rows_b", F.lit(0)).alias("rows_b"),
                    (F.coalesce("rows_a", F.lit(0)) - F.coalesce("rows_b", F.lit(0))).alias("delta"),
                    "fail_pct_a", "fail_pct_b")


def distribution(df: DataFrame, col: str) -> DataFrame:
    """AGG-19: counts and shares by a label column."""
    total = df.select(F.count(F.lit(1))).scalar()
    return (df.groupBy(F.col(col).alias("label")).agg(F.count(F.lit(1)).alias("count"))
            .withColumn("share", F.col("count") / total))


def boundary_contamination(df: DataFrame, source: str = "data_source", key: str = "api_name",
                           order=("timestamp", "event_id"), length: int = 30) -> DataFrame:
    """WIN-24: share of length-L windows (over key+time order, globally) whose
    rows come from more than one source.

    A window [i, i+L) is mixed iff a source change occurs inside it, i.e. the
    distance back to the latest change point before its last row is < L-1.
    Computed per key with the blocked scan so no task holds a whole key.
    """
    from faultline.operators import series
    idx = series.with_row_index(df.select(key, source, *order), key=None, order=[key, *order],
                                idx_col="gidx")
    b = series.blocked(idx, idx_col="gidx", block=max(4096, length), back=length - 1)
    w = Window.partitionBy("_blk").orderBy("gidx")
    prev = F.lag(source, 1).over(w)
    chg = F.when(prev.isNotNull() & ~prev.eqNullSafe(F.col(source)), F.col("gidx"))
    last_change = F.max(chg).over(w.rowsBetween(-(length - 2), 0))
    t = b.select("gidx", "_home", last_change.alias("_lc"))
    t = t.filter("_home").filter(F.col("gidx") >= length - 1)
    agg = t.agg(F.count(F.lit(1)).alias("total_sequences"),
                F.sum(F.when(F.col("_lc").isNotNull(), 1).otherwise(0)).alias("broken_sequences"))
    pct = F.lit(100.0) * F.col("broken_sequences") / F.greatest(F.col("total_sequences"), F.lit(1))
    return agg.select("total_sequences", F.coalesce("broken_sequences", F.lit(0)).alias("broken_sequences"),
                      pct.alias("broken_pct"), (pct > 1).alias("flag"))

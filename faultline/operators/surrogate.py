"""Logistic surrogate forecast (ML-26), telemetry fallback risk (ML-27),
prediction table (ML-28) and driver ranking (ML-31) — pure expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.scalars import clip, np_round, risk_label, sigmoid

W = C.SURROGATE_W
DRIVERS = ["Error rate", "Response time", "Error volatility", "Recent failures", "Load stress", "API profile"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def contributions(api, error_rate, rt_multiplier, error_volatility, load, recent_failures) -> list[Column]:
    bias = F.create_map(*[F.lit(x) for kv in C.SURROGATE_API_BIAS.items() for x in kv])
    return [
        F.lit(W["err"]) * _c(error_rate),
        F.lit(W["rt"]) * F.log(F.greatest(F.lit(1.0), _c(rt_multiplier))),
        F.lit(W["vol"]) * _c(error_volatility),
        F.lit(W["recent"]) * _c(recent_failures),
        F.lit(W["load"]) * F.greatest(F.lit(0.0), _c(load) - F.lit(1.2)),
        F.coalesce(F.element_at(bias, _c(api)), F.lit(0.0)),
    ]


def band(p: Column, horizon: int) -> Column:
    w = ((F.lit(0.045) + F.lit(0.16) * (F.lit(1.0) - F.abs(p - F.lit(0.5)) * F.lit(2.0)))
         * F.lit(C.SURROGATE_QHAT[horizon] / 0.52) * F.lit(C.SURROGATE_HSCALE[horizon]))
    return clip(w, 0.03, 0.42)


def horizon_p(p1: Column, horizon: int) -> Column:
    if horizon == 1:
        return p1
    base = F.lit(C.SURROGATE_BASE)
    return base + (p1 - base) * F.lit(C.SURROGATE_SHRINK[horizon])


def surrogate_forecast(df: DataFrame, api="api_name", error_rate="error_rate_rolling",
                       rt_multiplier="rt_multiplier", error_volatility="error_volatility",
                       load="burst_ratio", recent_failures="recent_failures",
                       horizons=(1, 5, 15)) -> DataFrame:
    """Adds p_h{h}, lower_h{h}, upper_h{h}, peak_risk, recommended_action,
    lead_time_min and the driver contributions (rounded to 3 dp)."""
    parts = contributions(api, error_rate, rt_multiplier, error_volatility, load, recent_failures)
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    z = F.lit(W["b0"]) + total
    out = df.withColumn("_p1", sigmoid(z))
    p1 = F.col("_p1")
    cols = []
    for h in horizons:
        p = horizon_p(p1, h)
        bw = band(p, h)
        cols += [p.alias(f"p_h{h}"),
                 clip(p - bw, 0.0, 1.0).alias(f"lower_h{h}"),
                 clip(p + bw, 0.0, 1.0).alias(f"upper_h{h}")]
    peak = F.greatest(*[horizon_p(p1, h) for h in horizons])
    action = (F.when(peak >= C.SURROGATE_HI, "reroute").when(peak >= C.SURROGATE_LO, "pre_warm")
              .otherwise("none"))
    lead = (F.when(peak >= 0.78, 1).when(peak >= C.SURROGATE_HI, 5).when(peak >= C.SURROGATE_LO, 15))
    drivers = F.struct(*[np_round(c, 3).alias(n) for n, c in zip(DRIVERS, parts)])
    return out.select("*", *cols, peak.alias("peak_risk"), action.alias("recommended_action"),
                      lead.alias("lead_time_min"), drivers.alias("drivers")).drop("_p1")


def fallback_risk(df: DataFrame, error_rate="error_rate", avg_rt="avg_rt_s", out="risk") -> DataFrame:
    """ML-27: min(1, 3*err + 2*max(0, rt - 0.5))."""
    r = F.least(F.lit(1.0), F.lit(3.0) * _c(error_rate)
                + F.lit(2.0) * F.greatest(F.lit(0.0), _c(avg_rt) - F.lit(0.5)))
    return df.withColumn(out, r)


def to_long(scored: DataFrame, horizons=(1, 5, 15),
            keep=("event_id", "api_name", "timestamp", "row_idx")) -> DataFrame:
    """Wide surrogate output -> long scored table (…, horizon, p, lower, upper, y, y_type)."""
    rows = [F.struct(F.lit(h).alias("horizon"), F.col(f"p_h{h}").alias("p"),
                     F.col(f"lower_h{h}").alias("lower"), F.col(f"upper_h{h}").alias("upper"),
                     F.col(f"y_h{h}").alias("y"), F.col(f"y_type_h{h}").alias("y_type"))
            for h in horizons]
    keep = [k for k in keep if k in scored.columns]
    return (scored.select(*keep, F.explode(F.array(*rows)).alias("_r"))
            .select(*keep, "_r.*").filter(F.col("y").isNotNull()))


def prediction_table(scored_long: DataFrame, lo: float = 0.35, hi: float = 0.65) -> DataFrame:
    """ML-28: one row per event: p per horizon, mean, risk label, actual (h1)."""
    g = scored_long.groupBy("event_id", "api_name", "timestamp").agg(
        *[F.max(F.when(F.col("horizon") == h, F.col("p"))).alias(f"p_h{h}") for h in (1, 5, 15)],
        F.max(F.when(F.col("horizon") == 1, F.col("y"))).alias("actual_h1"))
    mean = (F.col("p_h1") + F.col("p_h5") + F.col("p_h15")) / F.lit(3.0)
    return g.select("*", mean.alias("p_mean"), risk_label(mean, lo, hi).alias("risk"))


def rank_drivers(df: DataFrame, id_col: str = "event_id") -> DataFrame:
    """ML-31: unpivot driver contributions, rank by |value|, share of max."""
    m = F.map_from_arrays(F.array(*[F.lit(n) for n in DRIVERS]),
                          F.array(*[F.col("drivers").getField(n) for n in DRIVERS]))
    long = df.select(id_col, F.explode(m).alias("driver", "value"))
    w = Window.partitionBy(id_col).orderBy(F.abs("value").desc(), "driver")
    mx = F.max(F.abs("value")).over(Window.partitionBy(id_col))
    return long.select(id_col, "driver", "value", F.row_number().over(w).alias("rank"),
                       F.when(mx > 0, F.abs("value") / mx).otherwise(F.lit(0.0)).alias("share_of_max"))

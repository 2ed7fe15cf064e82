"""Decision rules (DEC-01..05, DEC-15, DEC-18, DEC-19) as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.scalars import np_round

D = C.DIAG


def _f(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def diagnose(df: DataFrame, out: str = "diagnosis") -> DataFrame:
    """DEC-01: first matching root cause -> struct(category, confidence,
    evidence map, remediation_hint)."""
    stress, n_elev = _f("systemic_stress_index"), _f("n_apis_elevated")
    avg_o, max_o = _f("avg_error_rate_others"), _f("max_error_rate_others")
    burst, traf = _f("burst_ratio"), _f("traffic_change")
    rtm, spk, slp = _f("rt_multiplier"), _f("latency_spike"), _f("latency_slope")
    eb, boost, er = _f("error_burst"), _f("error_rate_boost"), _f("error_rate_rolling")
    inst = _f("instability_index")

    def case(cat, conf, ev: dict, hint):
        return F.struct(
            F.lit(cat).alias("category"),
            np_round(F.least(F.lit(1.0), conf), 3).alias("confidence"),
            F.create_map(*[x for k, v in ev.items() for x in (F.lit(k), v)]).alias("evidence"),
            F.lit(hint).alias("remediation_hint"),
        )

    expr = (
        F.when((stress >= D["systemic_stress_hi"]) | (n_elev >= D["n_apis_elevated"]),
               case("cascade", (stress + max_o) / F.lit(1.2),
                    {"systemic_stress_index": stress, "n_apis_elevated": n_elev,
                     "avg_error_rate_others": avg_o}, "isolate_dependency"))
        .when((burst >= D["burst_ratio_hi"]) | (traf >= D["traffic_change_hi"]),
              case("overload", F.greatest(burst / 4.0, traf / 3.0),
                   {"burst_ratio": burst, "traffic_change": traf}, "throttle"))
        .when((rtm >= D["rt_multiplier_hi"]) | (spk >= D["latency_spike_hi"]),
              case("timeout", F.greatest(rtm / 4.0, spk),
                   {"rt_multiplier": rtm, "latency_spike": spk, "latency_slope": slp}, "backoff"))
        .when((eb >= D["error_burst_hi"]) | (boost >= D["error_boost_hi"]),
              case("error_surge", F.greatest(eb, boost + er),
                   {"error_burst": eb, "error_rate_boost": boost}, "circuit_break"))
        .otherwise(case("intermittent", inst + F.lit(0.2),
                        {"instability_index": inst}, "retry_jitter"))
    )
    return df.withColumn(out, expr)


def explain(diagnosis: Column) -> Column:
    """DEC-02: '[CATEGORY nn%] sentence'."""
    texts = F.create_map(*[F.lit(x) for kv in C.DIAG_TEXT.items() for x in kv])
    cat = diagnosis["category"]
    pct = F.format_number(diagnosis["confidence"] * 100, 0)
    return F.concat(F.lit("["), F.upper(cat), F.lit(" "), F.regexp_replace(pct, ",", ""), F.lit("%] "),
                    F.coalesce(F.element_at(texts, cat), F.lit("Unknown failure pattern.")))


def diag_features(metrics: DataFrame) -> DataFrame:
    """DEC-03: live health metrics -> diagnosis feature columns."""
    er = F.col("error_rate")
    return metrics.select(
        "*",
        er.alias("error_rate_rolling"),
        F.greatest(F.lit(0.0), er - F.lit(0.05)).alias("error_rate_boost"),
        F.when(F.col("baseline_rt") > 0, F.col("avg_response_time") / F.col("baseline_rt"))
        .otherwise(F.lit(1.0)).alias("rt_multiplier"),
    )


def remedies(df: DataFrame, category: str = "category") -> DataFrame:
    """DEC-04: remedy lookup; unknown categories map to 'intermittent'."""
    known = [r[0] for r in C.REMEDIES]
    cat = F.when(F.col(category).isin(*known), F.col(category)).otherwise(F.lit("intermittent"))
    action = F.create_map(*[x for r in C.REMEDIES for x in (F.lit(r[0]), F.lit(r[1]))])
    ticks = F.create_map(*[x for r in C.REMEDIES for x in (F.lit(r[0]), F.lit(r[2]))])
    red = F.create_map(*[x for r in C.REMEDIES for x in (F.lit(r[0]), F.lit(r[3]))])
    return df.select("*", F.element_at(action, cat).alias("remedy_action"),
                     F.element_at(ticks, cat).alias("recovery_ticks"),
                     F.element_at(red, cat).alias("risk_reduction"))


def decay_risk(df: DataFrame, risk: str = "risk", ticks_elapsed: str = "ticks") -> DataFrame:
    """DEC-05 closed form: risk after n ticks = max(0, risk - n*reduction),
    capped at the remedy's recovery_ticks; fix complete once n >= ticks."""
    n = F.least(F.col(ticks_elapsed), F.col("recovery_ticks"))
    return df.select("*",
                     F.greatest(F.lit(0.0), F.col(risk) - n * F.col("risk_reduction")).alias("risk_after"),
                     (F.col(ticks_elapsed) >= F.col("recovery_ticks")).alias("fix_complete"))


def hysteresis(df: DataFrame, p: str = "p", key="api_name", order: str = "row_idx",
               hi: float = 0.55, lo: float = 0.45, out: str = "alert") -> DataFrame:
    """DEC-18 Schmitt trigger: on at p>=hi, off at p<lo, otherwise hold the last
    state; starts off.  The last trigger position comes from a distributed
    running max, its value from an equi-join on (key, position)."""
    from faultline.operators import series
    ev = F.when(F.col(p) >= hi, 1).when(F.col(p) < lo, 0)
    t = df.withColumn("_ev", ev).withColumn("_evpos", F.when(F.col("_ev").isNotNull(), F.col(order)))
    cum = series.cumulative(t.select(key, order, "_evpos"), key, [order], ["_evpos"], agg="max")
    trig = t.filter(F.col("_ev").isNotNull()).select(key, F.col(order).alias("cum__evpos"), "_ev")
    j = (cum.select(key, order, "cum__evpos").join(trig, [key, "cum__evpos"], "left")
         .select(key, order, F.coalesce(F.col("_ev"), F.lit(0)).alias(out)))
    return df.join(j, [key, order], "left")


def debounce(df: DataFrame, state: str = "healthy", key="backend", order: str = "tick", n: int = 2,
             out: str = "confirmed") -> DataFrame:
    """DEC-15: a state change is acted on only at exactly the n-th equal
    consecutive poll: s_i == ... == s_{i-n+1} and s_{i-n} differs or is absent.
    Needs only n rows of look-back, so it runs on halo blocks (bounded tasks)."""
    from faultline.operators import series
    b = series.blocked(df, idx_col=order, block=max(1024, 4 * n), back=n)
    w = Window.partitionBy(key, "_blk").orderBy(order)
    same = F.lit(True)
    for k in range(1, n):
        same = same & F.lag(state, k).over(w).eqNullSafe(F.col(state)) & F.lag(state, k).over(w).isNotNull()
    prev = F.lag(state, n).over(w)
    first_of_run = prev.isNull() | ~prev.eqNullSafe(F.col(state))
    res = b.select(*df.columns, "_home", (same & first_of_run).alias(out)).filter("_home").drop("_home")
    return res


def roi(scenarios: DataFrame, reduction: Column | float, incidents: str = "incidents",
        cost: str = "cost_per_incident") -> DataFrame:
    """DEC-19: averted = round(incidents * reduction); saved = averted * cost."""
    red = reduction if isinstance(reduction, Column) else F.lit(reduction)
    averted = np_round(F.col(incidents) * red, 0)
    return scenarios.select("*", averted.alias("averted"), (averted * F.col(cost)).alias("saved"))


# --- DEC-17 / SCL-13 ----------------------------------------------------------------------
def record_json(fields: dict) -> Column:
    """JSON text of a flat record with keys sorted, in the ``json.dumps``
    layout the checksum is defined on ('{"a": 1, "b": "x"}')."""
    parts = []
    for i, k in enumerate(sorted(fields)):
        v = fields[k]
        sep = "" if i == 0 else ", "
        if isinstance(v, tuple):        # (column, 'str') marks a string field
            val = F.concat(F.lit('"'), v[0].cast("string"), F.lit('"'))
        else:
            val = v.cast("string")
        parts += [F.lit(f'{sep}"{k}": '), val]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def checksum(fields: dict) -> Column:
    return F.substring(F.sha2(record_json(fields), 256), 1, 16)


def parity(primary: DataFrame, replica: DataFrame, key: str, fields_fn, negative_fn=None) -> DataFrame:
    """DEC-17: per key, checksum(primary) == checksum(replica); the negative
    control (a mutated replica record) must differ."""
    a = primary.select(key, checksum(fields_fn(primary)).alias("checksum_primary"))
    b = replica.select(key, checksum(fields_fn(replica)).alias("checksum_replica"),
                       *([checksum(negative_fn(replica)).alias("_neg")] if negative_fn else []))
    j = a.join(b, key, "full_outer")
    out = j.select(key, "checksum_primary", "checksum_replica",
                   F.coalesce(F.col("checksum_primary") == F.col("checksum_replica"), F.lit(False)).alias("parity_ok"))
    if negative_fn:
        out = out.join(b.select(key, "_neg"), key, "left").select(
            *out.columns, (F.col("_neg") != F.col("checksum_primary")).alias("negative_control_differs"))
    return out

"""Policy back-tests on scored transactions (DEC-06..10, AGG-20, JN-11/12).

Random draws of the reference are re-specified as hash-seeded uniforms of the
transaction id (SCL-16), so results are deterministic, distributed and
reproducible by SQL.  Latencies are carried in integer milliseconds so
averages are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.scalars import hash_uniform, np_round
from faultline.operators import series
from faultline.operators.joins import least_risk_backup

MS = {"normal": int(C.LATENCY_NORMAL * 1000), "retry": int(C.LATENCY_RETRY * 1000),
      "switch": int(C.LATENCY_SWITCH * 1000)}


def measured_rates(telemetry: DataFrame, api: str = "api_name") -> DataFrame:
    """Per-API failure rate (null success counts as success)."""
    return telemetry.groupBy(api).agg(
        (F.lit(1.0) - F.avg(F.coalesce(F.col("success"), F.lit(1)))).alias("failure_rate"))


def proactive(tx: DataFrame, rates: DataFrame, hi: float = C.HIGH_RISK, lo: float = C.LOW_RISK,
              seed: str = "proactive", variant: str = "measured") -> DataFrame:
    """DEC-06 (variant='measured') / DEC-07 (variant='scaled').

    measured: p>hi -> switch to the least-risk other API if its measured rate
    is below the primary's (failure ~ backup rate) else hold; lo<p<=hi ->
    retry (failure halves); else normal.
    scaled: switch fails w.p. .25*y, retry .5*y.
    """
    u = hash_uniform(F.col("event_id"), seed)
    y = F.col("y").cast("double")
    if variant == "scaled":
        action = F.when(F.col("p") > hi, "switch").when(F.col("p") > lo, "retry").otherwise("normal")
        failed = (F.when(F.col("p") > hi, u < y * F.lit(0.25))
                  .when(F.col("p") > lo, u < y * F.lit(0.5))
                  .otherwise(F.col("y") == 1))
        out = tx.select("*", action.alias("action"), failed.cast("int").alias("failed"))
    else:
        bk = least_risk_backup(rates)   # one row per API (bounded)
        t = tx.join(F.broadcast(bk.select("api_name", F.col("failure_rate").alias("primary_rate"),
                                          "backup_api", "backup_rate")), "api_name", "left")
        healthier = F.col("backup_api").isNotNull() & (F.col("backup_rate") < F.col("primary_rate"))
        action = (F.when((F.col("p") > hi) & healthier, "switch").when(F.col("p") > hi, "hold")
                  .when(F.col("p") > lo, "retry").otherwise("normal"))
        failed = (F.when((F.col("p") > hi) & healthier, u < F.col("backup_rate"))
                  .when(F.col("p") > hi, F.col("y") == 1)
                  .when(F.col("p") > lo, (F.col("y") == 1) & (u < F.lit(0.5)))
                  .otherwise(F.col("y") == 1))
        out = t.select(*tx.columns, action.alias("action"), failed.cast("int").alias("failed"))
    lat = (F.when(F.col("action") == "switch", MS["switch"])
           .when(F.col("action").isin("retry", "hold"), MS["retry"]).otherwise(MS["normal"]))
    return out.withColumn("latency_ms", lat)


def reactive(tx: DataFrame, key: str = "api_name", order: str = "row_idx", seed: str = "reactive",
             variant: str = "sequential", backup_fail: float = C.REACTIVE_BACKUP_FAIL) -> DataFrame:
    """DEC-08: after a primary failure the next transaction of the stream goes
    to the backup once.  Closed form: a row is served by the backup iff the
    run of consecutive raw failures just before it has odd length — run
    lengths come from a distributed exclusive running max of the last
    success position (no sequential loop, no whole-key task).
    DEC-09 (variant='post_fail'): failure => switch latency, same outcome.
    """
    if variant == "post_fail":
        return tx.select("*", F.when(F.col("y") == 1, "post-fail-switch").otherwise("normal").alias("action"),
                         F.col("y").cast("int").alias("failed"),
                         F.when(F.col("y") == 1, MS["switch"]).otherwise(MS["normal"]).alias("latency_ms"))
    ok_pos = F.when(F.col("y") == 0, F.col(order))
    cum = series.cumulative(tx.select(key, order, "y", ok_pos.alias("ok_pos")), key, [order], ["ok_pos"],
                            agg="max")
    # rho = length of the failure run ending at this row (inclusive max of the
    # last success position excludes the row itself when it is a failure)
    rho = F.col(order) - F.coalesce(F.col("cum_ok_pos"), F.lit(-1))
    nxt = cum.select(F.col(key), (F.col(order) + 1).alias(order),
                     ((F.col("y") == 1) & (rho % 2 == 1)).alias("_backup"))
    t = tx.join(nxt, [key, order], "left")
    backup = F.coalesce(F.col("_backup"), F.lit(False))
    u = hash_uniform(F.col("event_id"), seed)
    return t.select(*tx.columns,
                    F.when(backup, "switch").otherwise("normal").alias("action"),
                    F.when(backup, (u < F.lit(backup_fail)).cast("int")).otherwise(F.col("y").cast("int"))
                    .alias("failed"),
                    F.when(backup, MS["switch"]).otherwise(MS["normal"]).alias("latency_ms"))


def policy_metrics(results: DataFrame, label: str, cost: float = C.COST_PER_FAILURE,
                   tx_per_year: int = C.TRANSACTIONS_PER_YEAR) -> DataFrame:
    """AGG-20: failures, successes, rate, switches, avg latency, cost, annual cost."""
    g = results.agg(F.count(F.lit(1)).alias("n_transactions"), F.sum("failed").alias("failures"),
                    F.sum(F.when(F.col("action") == "switch", 1).otherwise(0)).alias("switches"),
                    F.sum("latency_ms").alias("_lat"))
    n, f = F.col("n_transactions"), F.col("failures")
    return g.select(F.lit(label).alias("label"), "n_transactions", (n - f).alias("successes"), f,
                    (f / n).alias("failure_rate"), "switches",
                    np_round(F.col("_lat") / (n * F.lit(1000.0)), 4).alias("avg_latency_sec"),
                    np_round(f * F.lit(cost), 2).alias("cost"),
                    np_round(f / n * F.lit(float(tx_per_year)) * F.lit(cost), 2).alias("annual_cost_usd"))


def compare_policies(pro: DataFrame, react: DataFrame) -> DataFrame:
    """DEC-10: failure reduction, annual saving, latency delta, failures avoided.
    Both inputs are one-row metric tables; they are stacked and folded with
    conditional aggregates (no join)."""
    both = pro.withColumn("_side", F.lit("p")).unionByName(react.withColumn("_side", F.lit("r")))

    def side(s, c):
        return F.max(F.when(F.col("_side") == s, F.col(c)))
    g = both.agg(*[side(s, c).alias(f"{s}_{c}") for s in ("p", "r")
                   for c in ("failures", "annual_cost_usd", "avg_latency_sec")])
    return g.select(
        ((F.col("r_failures") - F.col("p_failures")) / F.greatest(F.col("r_failures"), F.lit(1)))
        .alias("failure_reduction"),
        (F.col("r_annual_cost_usd") - F.col("p_annual_cost_usd")).alias("annual_saving_usd"),
        (F.col("p_avg_latency_sec") - F.col("r_avg_latency_sec")).alias("latency_delta_sec"),
        (F.col("r_failures") - F.col("p_failures")).alias("failures_avoided"))

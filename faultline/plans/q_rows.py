"""Registered queries: filters, splits, sequence summaries, labels, scalers, SQL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions import scalars as S
from faultline.functions.scalars import hash_uniform_sql as HU
from faultline.operators import decide, features, joins, metrics, ml, ordering, rows
from faultline.plans import sql as Q
from faultline.plans.catalog import register
from faultline.plans.feature_table import feature_table
from faultline.plans.q_evaluation import S as SCORED
from faultline.plans.scored import scored_long
from faultline.sources import fixtures as FX

T_ = "WITH " + FX.telemetry_sql()


@register("flt_between_dates", T_ + """
SELECT event_id FROM telemetry WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'""")
def q_between(spark, sf):
    return rows.between_dates(FX.telemetry(spark, sf), "2024-01-05", "2024-01-12").select("event_id")


@register("flt_before", T_ + """
SELECT event_id FROM telemetry WHERE "timestamp" < TIMESTAMP '2024-01-20'""")
def q_before(spark, sf):
    return rows.before(FX.telemetry(spark, sf), "2024-01-20").select("event_id")


@register("flt_min_group_size", T_ + """
SELECT event_id, user_id FROM telemetry WHERE user_id IN (SELECT user_id FROM telemetry GROUP BY user_id HAVING count(*) >= 65)""")
def q_group_size(spark, sf):
    return rows.min_group_size(FX.telemetry(spark, sf), "user_id", 65).select("event_id", "user_id")


@register("prj_available_narrow", T_ + """
SELECT event_id, CAST(response_time AS FLOAT)::DOUBLE AS response_time, CAST(success AS TINYINT)::INT AS success FROM telemetry""")
def q_narrow(spark, sf):
    t, missing = rows.available(FX.telemetry(spark, sf), ["event_id", "response_time", "success", "no_such_column"])
    assert missing == ["no_such_column"]
    return rows.narrow(t, {"response_time": "float", "success": "tinyint"}).select(
        "event_id", F.col("response_time").cast("double").alias("response_time"), F.col("success").cast("int").alias("success"))


@register("smp_random_split", T_ + f"""
SELECT event_id, CASE WHEN {HU('event_id', 'split')} < 0.8 THEN 'train' ELSE 'test' END AS part FROM telemetry""")
def q_random_split(spark, sf):
    return rows.random_split(FX.telemetry(spark, sf), 0.8).select("event_id", "part")


@register("smp_ordered_split", T_ + """
, i AS (SELECT event_id, row_number() OVER (ORDER BY "timestamp", event_id) - 1 AS i, count(*) OVER () AS n FROM telemetry)
SELECT event_id, CASE WHEN i < floor(n * 0.7::DOUBLE) THEN 'train' WHEN i < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM i""")
def q_ordered_split(spark, sf):
    return rows.ordered_split(FX.telemetry(spark, sf)).select("event_id", "part")


SUMMARISED = ("response_time", "status_code", "request_count")


def _summaries_sql() -> str:
    stats = ", ".join(f"avg({c}) OVER f AS {c}_m, {c} AS {c}_l, regr_slope(CAST({c} AS DOUBLE), CAST(row_idx AS DOUBLE)) OVER f AS {c}_s" for c in SUMMARISED)
    cols = ", ".join(f"round({c}_m, 6) AS {c}_mean, {c}_l AS {c}_last, round({c}_s, 6) AS {c}_slope" for c in SUMMARISED)
    return T_ + f"""
, i AS (SELECT *, row_number() OVER (PARTITION BY api_name ORDER BY "timestamp", event_id) - 1 AS row_idx, 1 - success AS bad FROM telemetry),
w AS (SELECT event_id, api_name, row_idx, {stats}, lead(bad, 1) OVER o AS y_h1, lead(bad, 5) OVER o AS y_h5, lead(bad, 15) OVER o AS y_h15
      FROM i WINDOW o AS (PARTITION BY api_name ORDER BY row_idx), f AS (PARTITION BY api_name ORDER BY row_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT event_id, api_name, row_idx, {cols}, y_h1, y_h5, y_h15 FROM w WHERE row_idx >= 29 AND y_h15 IS NOT NULL"""


@register("win_sequence_summaries", _summaries_sql())
def q_sequences(spark, sf):
    """Every full window of 30 rows that has all its targets."""
    s = rows.sequence_summaries(FX.telemetry(spark, sf), SUMMARISED, 30, 1)
    return s.withColumns({f"{c}_{k}": F.round(f"{c}_{k}", 6) for c in SUMMARISED for k in ("mean", "slope")})


@register("win_sequence_summaries_step1", T_ + """
, i AS (SELECT *, row_number() OVER (PARTITION BY api_name ORDER BY "timestamp", event_id) - 1 AS row_idx, 1 - success AS bad FROM telemetry),
w AS (SELECT event_id, api_name, row_idx, avg(response_time) OVER f AS m, response_time AS l, regr_slope(CAST(response_time AS DOUBLE), CAST(row_idx AS DOUBLE)) OVER f AS s,
        lead(bad, 1) OVER o AS y_h1, lead(bad, 5) OVER o AS y_h5, lead(bad, 15) OVER o AS y_h15
      FROM i WINDOW o AS (PARTITION BY api_name ORDER BY row_idx), f AS (PARTITION BY api_name ORDER BY row_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT event_id, api_name, row_idx, round(m, 6) AS response_time_mean, l AS response_time_last, round(s, 6) AS response_time_slope, y_h1, y_h5, y_h15
FROM w WHERE row_idx >= 29 AND y_h15 IS NOT NULL""")
def q_sequences_step1(spark, sf):
    s = rows.sequence_summaries(FX.telemetry(spark, sf), ["response_time"], 30, 1)
    return s.withColumn("response_time_mean", F.round("response_time_mean", 6)).withColumn("response_time_slope", F.round("response_time_slope", 6))


@register("win_running_best", T_ + """
, d AS (SELECT CAST("timestamp" AS DATE) AS d, max(request_count) AS v FROM telemetry GROUP BY 1)
SELECT CAST(d AS VARCHAR) AS day, v, coalesce(v < min(v) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM d""")
def q_best(spark, sf):
    d = FX.telemetry(spark, sf).groupBy(F.to_date("timestamp").alias("d")).agg(F.max("request_count").alias("v"))
    return rows.running_best(d, "v", "d").select(F.col("d").cast("string").alias("day"), "v", "improved")


@register("win_ema_unadjusted", "WITH RECURSIVE " + FX.telemetry_sql() + """
, i AS MATERIALIZED (SELECT event_id, api_name, CAST(response_time AS DOUBLE) AS x, row_number() OVER (PARTITION BY api_name ORDER BY "timestamp", event_id) AS k FROM telemetry),
e(event_id, api_name, k, a, b) AS (
  SELECT event_id, api_name, k, x, x FROM i WHERE k = 1
  UNION ALL SELECT i.event_id, i.api_name, i.k, 2.0 / 11 * i.x + 9.0 / 11 * e.a, 2.0 / 31 * i.x + 29.0 / 31 * e.b
  FROM e JOIN i ON i.api_name = e.api_name AND i.k = e.k + 1)
SELECT event_id, round(a, 6) AS response_time_ema_10, round(b, 6) AS response_time_ema_30 FROM e""")
def q_ema(spark, sf):
    f = features.series_features(FX.telemetry(spark, sf), "batch20")
    return f.select("event_id", *[F.round(c, 6).alias(c) for c in ("response_time_ema_10", "response_time_ema_30")])


@register("win_interactions", Q.full_features_with() + """
SELECT event_id, response_time * request_count / 100.0 AS rt_x_load, error_rate_rolling * is_financial_peak AS err_x_peak FROM full_feat""")
def q_interactions(spark, sf):
    return features.interactions(feature_table(spark, sf)).select("event_id", "rt_x_load", "err_x_peak")


@register("top_high_risk_rows", SCORED + f"""
, s1 AS (SELECT event_id, api_name, row_idx, p FROM scored WHERE horizon = 1),
h AS (SELECT *, row_number() OVER (PARTITION BY api_name ORDER BY p DESC, row_idx) AS rank FROM s1 WHERE p >= {C.HIGH_RISK}),
f AS (SELECT *, row_number() OVER (PARTITION BY api_name ORDER BY row_idx) AS rank FROM s1 WHERE api_name NOT IN (SELECT api_name FROM h))
SELECT event_id, api_name, rank FROM h WHERE rank <= 3 UNION ALL SELECT event_id, api_name, rank FROM f WHERE rank <= 3""")
def q_top(spark, sf):
    s = scored_long(spark, sf).where("horizon = 1").select("event_id", "api_name", "row_idx", "p")
    return rows.top_risk(s).select("event_id", "api_name", "rank")


_ERR = "CASE event_label WHEN 'normal' THEN NULL " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.ERROR_LABELS.items() if v is not None and k != "normal") + " ELSE 'unknown_error' END"


@register("scl_event_labels", "WITH " + FX.tagged_telemetry_sql() + f"""
SELECT event_id, {_ERR} AS error_label, CASE WHEN status_code < 400 THEN 1 ELSE 0 END AS ok_batch,
       CASE WHEN status_code < 500 THEN 1 ELSE 0 END AS ok_live FROM tagged""")
def q_labels(spark, sf):
    t = FX.tagged_telemetry(spark, sf)
    return t.select("event_id", S.event_error_label("event_label").alias("error_label"), S.is_success("status_code").alias("ok_batch"),
                    S.is_success("status_code", 500).alias("ok_live"))


@register("ml_min_max_one_hot", T_ + """
, m AS (SELECT min(response_time) AS a, max(response_time) AS b FROM telemetry)
SELECT event_id, round((response_time - a) / (b - a) * 5.0, 9) AS scaled, """ + ", ".join(
    f"CASE WHEN api_name = '{a}' THEN 1 ELSE 0 END AS api_name_{a}" for a in C.ALL_APIS) + " FROM telemetry, m")
def q_scale(spark, sf):
    t = ml.one_hot(ml.min_max_scale(FX.telemetry(spark, sf), "response_time", 0.0, 5.0, "scaled"), "api_name", C.ALL_APIS)
    return t.select("event_id", F.round("scaled", 9).alias("scaled"), *[f"api_name_{a}" for a in C.ALL_APIS])


_TEXT = "CASE category " + " ".join("WHEN '{}' THEN '{}'".format(k, v.replace("'", "''")) for k, v in C.DIAG_TEXT.items()) + " ELSE 'Unknown failure pattern.' END"


@register("dec_explanations", Q.full_features_with() + f""",
d AS (SELECT event_id, {Q.diagnose_case()} AS category, {Q.diagnose_confidence()} AS confidence FROM full_feat)
SELECT event_id, '[' || upper(category) || ' ' || CAST(CAST(round_even(confidence * 100, 0) AS INT) AS VARCHAR) || '%] ' || {_TEXT} AS explanation FROM d""")
def q_explain(spark, sf):
    d = decide.diagnose(feature_table(spark, sf))
    return d.select("event_id", decide.explain(F.col("diagnosis")).alias("explanation"))


@register("dec_live_features", T_ + """
, h AS (SELECT api_name, avg(response_time) AS avg_response_time, 1.0 - avg(success) AS error_rate, 200.0 AS baseline_rt FROM telemetry GROUP BY 1)
SELECT api_name, round(error_rate, 9) AS error_rate_rolling, round(greatest(0.0, error_rate - 0.05), 9) AS error_rate_boost,
       round(avg_response_time / baseline_rt, 9) AS rt_multiplier FROM h""")
def q_live(spark, sf):
    h = FX.telemetry(spark, sf).groupBy("api_name").agg(F.avg("response_time").alias("avg_response_time"),
                                                        (F.lit(1.0) - F.avg("success")).alias("error_rate"), F.lit(200.0).alias("baseline_rt"))
    d = decide.diag_features(h)
    return d.select("api_name", *[F.round(c, 9).alias(c) for c in ("error_rate_rolling", "error_rate_boost", "rt_multiplier")])


@register("udf_sql_functions", T_ + """
SELECT event_id, CASE WHEN request_count / 100.0 >= 0.65 THEN 'HIGH' WHEN request_count / 100.0 >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
       1.0::DOUBLE / (1.0 + exp(-(response_time / 100.0))) AS squashed, CASE WHEN status_code < 400 THEN 1 ELSE 0 END AS ok FROM telemetry""")
def q_udf(spark, sf):
    rows.register_functions(spark)
    return FX.telemetry(spark, sf).select("event_id", F.expr("risk_label(request_count / 100.0D)").alias("risk"),
                                          F.expr("logistic(response_time / 100.0D)").alias("squashed"), F.expr("request_ok(status_code)").alias("ok"))


# --- whole-table order, windows by time, sequences -----------------------------------------------------
@register("top_sorted", T_ + """
SELECT event_id, row_number() OVER (ORDER BY "timestamp", event_id) - 1 AS by_time, row_number() OVER (ORDER BY api_name, "timestamp", event_id) - 1 AS by_api FROM telemetry""")
def q_sorted(spark, sf):
    t = FX.telemetry(spark, sf).select("event_id", "timestamp", "api_name")
    a = ordering.sort_series(t, ("timestamp", "event_id"), "by_time")
    return ordering.sort_series(a, ("api_name", "timestamp", "event_id"), "by_api").select("event_id", "by_time", "by_api")


@register("top_latest_earliest", T_ + """
, i AS (SELECT event_id, row_number() OVER (ORDER BY "timestamp", event_id) AS a, row_number() OVER (ORDER BY "timestamp" DESC, event_id DESC) AS b FROM telemetry)
SELECT 'latest' AS side, event_id FROM i WHERE b <= 700 UNION ALL SELECT 'earliest', event_id FROM i WHERE a <= 300""")
def q_latest(spark, sf):
    t = FX.telemetry(spark, sf).select("event_id", "timestamp")
    return (ordering.latest(t, 700).select(F.lit("latest").alias("side"), "event_id")
            .unionByName(ordering.earliest(t, 300).select(F.lit("earliest").alias("side"), "event_id")))


@register("flt_adaptive_window", T_ + """
, i AS (SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, event_id DESC) AS b FROM telemetry),
j AS (SELECT *, row_number() OVER (ORDER BY "timestamp" DESC, event_id DESC) AS b FROM telemetry WHERE "timestamp" < TIMESTAMP '2024-01-20'),
rate AS (SELECT avg(1.0 - success) AS r FROM i WHERE b <= 800)
SELECT 0.05 AS min_rate, event_id FROM (SELECT event_id, r >= 0.05 AS ok, true AS recent FROM i, rate WHERE b <= 800 UNION ALL
                                        SELECT event_id, r < 0.05, false FROM j, rate WHERE b <= 800) WHERE ok
UNION ALL
SELECT 0.5, event_id FROM (SELECT event_id, r >= 0.5 AS ok FROM i, rate WHERE b <= 800 UNION ALL SELECT event_id, r < 0.5 FROM j, rate WHERE b <= 800) WHERE ok""")
def q_adaptive(spark, sf):
    """The usual floor, and one that no window of the log meets."""
    t = FX.telemetry(spark, sf).select("event_id", "timestamp", "success")
    both = [ordering.adaptive_window(t, 800, r, "2024-01-20").select(F.lit(r).alias("min_rate"), "event_id") for r in (0.05, 0.5)]
    return both[0].unionByName(both[1])


@register("flt_failures", T_ + """
SELECT 'all' AS filter, event_id FROM telemetry WHERE success = 0
UNION ALL SELECT 'crypto_api', event_id FROM telemetry WHERE success = 0 AND api_name = 'crypto_api'
UNION ALL SELECT 'last_error_type', event_id FROM telemetry WHERE success = 0 AND error_type = (SELECT max(error_type) FROM telemetry)""")
def q_failures(spark, sf):
    t = FX.telemetry(spark, sf)
    kind = t.select(F.max("error_type")).scalar()
    t = t.withColumn("_kind", kind)
    parts = [("all", ordering.failures(t)), ("crypto_api", ordering.failures(t, api="crypto_api")),
             ("last_error_type", ordering.failures(t).where(F.col("error_type") == F.col("_kind")))]
    out = [d.select(F.lit(n).alias("filter"), "event_id") for n, d in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


SEQ = ("response_time", "status_code", "request_count", "success")


@register("win_sequences", T_ + """
, i AS (SELECT *, row_number() OVER (PARTITION BY api_name ORDER BY "timestamp", event_id) - 1 AS row_idx,
       [""" + ", ".join(f"CAST(round({c} * 100) AS BIGINT)" for c in SEQ) + """] AS x, CAST(1 - success AS INT) AS bad FROM telemetry),
w AS (SELECT event_id, api_name, row_idx, list(x) OVER f AS win, lead(bad, 1) OVER o AS y_h1, lead(bad, 5) OVER o AS y_h5, lead(bad, 15) OVER o AS y_h15
      FROM i WINDOW o AS (PARTITION BY api_name ORDER BY row_idx), f AS (PARTITION BY api_name ORDER BY row_idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT event_id, api_name, row_idx, len(win) AS length, len(win[1]) AS width, sha256(array_to_string(flatten(win), ',')) AS window_sha256,
       coalesce(y_h1, -1) AS y_h1, coalesce(y_h5, -1) AS y_h5, coalesce(y_h15, -1) AS y_h15 FROM w WHERE row_idx >= 29""")
def q_windows_full(spark, sf):
    """Every window of 30 rows, the last ones without targets too (-1), by the digest of its values in hundredths."""
    s = ordering.sequences(FX.telemetry(spark, sf), SEQ, 30, 1, (1, 5, 15))
    flat = F.transform(F.flatten("window"), lambda x: F.round(x * 100).cast("long").cast("string"))
    return s.select("event_id", "api_name", "row_idx", F.size("window").cast("long").alias("length"), F.size(F.col("window")[0]).cast("long").alias("width"),
                    F.sha2(F.array_join(flat, ","), 256).alias("window_sha256"), *[F.coalesce(f"y_h{h}", F.lit(-1)).alias(f"y_h{h}") for h in (1, 5, 15)])


@register("jn_align_targets", T_ + """
SELECT event_id, coalesce(lead(1 - success, 30) OVER w, -1) AS y_h1, coalesce(lead(1 - success, 34) OVER w, -1) AS y_h5, coalesce(lead(1 - success, 44) OVER w, -1) AS y_h15
FROM telemetry WINDOW w AS (PARTITION BY api_name ORDER BY "timestamp", event_id)""")
def q_align(spark, sf):
    """JN-14: the targets of the window of 30 rows that starts at each row."""
    t = joins.align_targets(FX.telemetry(spark, sf).select("event_id", "api_name", "timestamp", "success"), length=30)
    return t.select("event_id", *[F.coalesce(f"y_h{h}", F.lit(-1)).alias(f"y_h{h}") for h in (1, 5, 15)])


@register("ml_model_comparison", SCORED.rstrip() + """,
half AS (SELECT s.horizon, s.p, s.y, t.data_source = 'synthetic' AS fresh FROM scored s JOIN telemetry t USING (event_id)),
r AS (SELECT horizon, fresh, y, avg(k) OVER (PARTITION BY horizon, fresh, p) AS rk, count(*) FILTER (y = 1) OVER g AS pos, count(*) FILTER (y = 0) OVER g AS neg
      FROM (SELECT *, row_number() OVER (PARTITION BY horizon, fresh ORDER BY p) AS k FROM half) WINDOW g AS (PARTITION BY horizon, fresh)),
a AS (SELECT horizon, fresh, (sum(rk) FILTER (y = 1) - max(pos) * (max(pos) + 1) / 2.0) / (max(pos) * max(neg)) AS auc FROM r GROUP BY 1, 2)
SELECT o.horizon, round(o.auc, 6) AS old_auc, round(n.auc, 6) AS new_auc, round(n.auc - o.auc, 6) AS delta, n.auc - o.auc >= 0.001 AS accepted
FROM a o JOIN a n ON o.horizon = n.horizon AND NOT o.fresh AND n.fresh""")
def q_compare(spark, sf):
    """JN-15, ML-30: AUC by horizon on one source's rows against the other's."""
    s = scored_long(spark, sf).join(FX.telemetry(spark, sf).select("event_id", "data_source"), "event_id")
    both = [metrics.roc_auc(s.where(c), by="horizon") for c in (F.col("data_source") != "synthetic", F.col("data_source") == "synthetic")]
    out = joins.compare_metrics(*both)
    return out.select("horizon", F.round("old_auc", 6).alias("old_auc"), F.round("new_auc", 6).alias("new_auc"), F.round("delta", 6).alias("delta"),
                      metrics.accept(F.col("old_auc"), F.col("new_auc")).alias("accepted"))

"""Registered queries: surrogate scoring and the evaluation suite (ML-*, TOP-05, AGG-19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import constants as C
from faultline.operators import aggregates as A
from faultline.operators import metrics as M
from faultline.operators import surrogate as SG
from faultline.plans import sql as Q
from faultline.plans.catalog import register
from faultline.plans.scored import HORIZONS, RECENT_N, chrono_positions, chrono_slice, scored_long, scored_wide
from faultline.session import reliable_checkpoint
from faultline.sources import fixtures as FX


def d(x: float) -> str:
    return f"{float(x)!r}::DOUBLE"


def _clip(e: str, lo: float, hi: float) -> str:
    return f"least(greatest({e}, {d(lo)}), {d(hi)})"


def _hp(h: int) -> str:
    if h == 1:
        return "p1"
    b = d(C.SURROGATE_BASE)
    return f"({b} + (p1 - {b}) * {d(C.SURROGATE_SHRINK[h])})"


def _band(p: str, h: int) -> str:
    w = (f"(({d(0.045)} + {d(0.16)} * ({d(1.0)} - abs({p} - {d(0.5)}) * {d(2.0)})) "
         f"* {d(C.SURROGATE_QHAT[h] / 0.52)} * {d(C.SURROGATE_HSCALE[h])})")
    return _clip(w, 0.03, 0.42)


def scored_ctes() -> str:
    W = C.SURROGATE_W
    bias = "COALESCE(CASE api_name " + " ".join(
        f"WHEN '{k}' THEN {d(v)}" for k, v in C.SURROGATE_API_BIAS.items()) + f" END, {d(0.0)})"
    leads = ",\n    ".join(
        f"lead(1 - success, {h}) OVER w AS y_h{h}, lead(error_type, {h}) OVER w AS y_type_h{h}" for h in HORIZONS)
    c = [f"{d(W['err'])} * error_rate_rolling",
         f"{d(W['rt'])} * ln(greatest({d(1.0)}, rt_multiplier))",
         f"{d(W['vol'])} * error_volatility",
         f"{d(W['recent'])} * recent_failures",
         f"{d(W['load'])} * greatest({d(0.0)}, burst_ratio - {d(1.2)})",
         bias]
    total = c[0]
    for x in c[1:]:
        total = f"({total} + {x})"
    peak = "greatest(" + ", ".join(_hp(h) for h in HORIZONS) + ")"
    parts = []
    for h in HORIZONS:
        p = _hp(h)
        bw = _band(p, h)
        parts.append(f"SELECT event_id, api_name, \"timestamp\", row_idx, {h} AS horizon, {p} AS p, "
                     f"{_clip(f'{p} - {bw}', 0.0, 1.0)} AS lower, {_clip(f'{p} + {bw}', 0.0, 1.0)} AS upper, "
                     f"y_h{h} AS y, y_type_h{h} AS y_type FROM sc2 WHERE y_h{h} IS NOT NULL")
    union = "\n  UNION ALL\n  ".join(parts)
    return Q.full_features_with() + f""",
sc0 AS (
  SELECT *,
    CAST(coalesce(sum(1 - success) OVER (PARTITION BY api_name ORDER BY row_idx
         ROWS BETWEEN {RECENT_N} PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS recent_failures,
    {leads}
  FROM full_feat WINDOW w AS (PARTITION BY api_name ORDER BY row_idx)
),
sc1 AS (SELECT *, {d(W['b0'])} + {total} AS z FROM sc0),
sc2 AS (
  SELECT *, {d(1.0)} / ({d(1.0)} + exp(-z)) AS p1 FROM sc1
),
sc3 AS (
  SELECT *, {peak} AS peak_risk FROM sc2
),
scored AS (
  {union}
)"""


S = scored_ctes() + "\n"


def _scored(spark, sf):
    return scored_long(spark, sf)


@register("ml_scored_table", S + "SELECT * FROM scored")
def q_scored(spark, sf):
    return _scored(spark, sf)


@register("ml_action_distribution", S + f"""
SELECT CASE WHEN peak_risk >= {C.SURROGATE_HI} THEN 'reroute' WHEN peak_risk >= {C.SURROGATE_LO} THEN 'pre_warm'
            ELSE 'none' END AS label, count(*) AS count,
       count(*) / (SELECT count(*) FROM sc3) AS share
FROM sc3 GROUP BY 1""")
def q_action_dist(spark, sf):
    return A.distribution(scored_wide(spark, sf), "recommended_action")


def _auc_ctes(by: str) -> str:
    return S + f"""
, cnt AS (SELECT {by}, p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY {by}, p),
cum AS (SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM cnt),
g AS (SELECT {by}, sum(CAST(pos AS DOUBLE) * (CAST(cum_neg AS DOUBLE) - CAST(neg AS DOUBLE) / 2.0)) AS u,
             sum(pos) AS n_pos, sum(neg) AS n_neg FROM cum GROUP BY {by}),
auc_t AS (SELECT {by}, CASE WHEN n_pos > 0 AND n_neg > 0 THEN u / (CAST(n_pos AS DOUBLE) * CAST(n_neg AS DOUBLE)) END AS auc,
       CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg FROM g)
""".replace("\n, cnt AS", ",\ncnt AS", 1)


def _auc_sql(by: str) -> str:
    return _auc_ctes(by) + "SELECT * FROM auc_t"


@register("ml_roc_auc", _auc_sql("horizon"))
def q_auc(spark, sf):
    return M.roc_auc(_scored(spark, sf))


@register("ml_auc_by_api", _auc_sql("api_name, horizon"))
def q_auc_api(spark, sf):
    return M.roc_auc(_scored(spark, sf), by=("api_name", "horizon"))


@register("ml_roc_curve", S + """
, cnt AS (SELECT horizon, p AS score, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(neg) OVER w AS cum_neg FROM cnt
        WINDOW w AS (PARTITION BY horizon ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
tot AS (SELECT horizon, sum(pos) AS P, sum(neg) AS N FROM cnt GROUP BY 1)
SELECT horizon, score AS threshold, CASE WHEN N > 0 THEN cum_neg / N END AS fpr,
       CASE WHEN P > 0 THEN cum_pos / P END AS tpr
FROM cum JOIN tot USING (horizon)""".replace("\n, cnt AS", ",\ncnt AS", 1))
def q_roc_curve(spark, sf):
    return M.roc_curve(_scored(spark, sf))


@register("ml_average_precision", S + """
, cnt AS (SELECT horizon, p AS score, sum(y) AS pos, sum(y) + sum(1 - y) AS tot FROM scored GROUP BY 1, 2),
cum AS (SELECT *, sum(pos) OVER w AS cum_pos, sum(tot) OVER w AS cum_tot FROM cnt
        WINDOW w AS (PARTITION BY horizon ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT horizon, sum(CAST(pos AS DOUBLE) * CAST(cum_pos AS DOUBLE) / CAST(cum_tot AS DOUBLE)) AS s,
             sum(pos) AS n_pos FROM cum GROUP BY 1)
SELECT horizon, CASE WHEN n_pos > 0 THEN s / n_pos END AS average_precision, CAST(n_pos AS BIGINT) AS n_pos
FROM g""".replace("\n, cnt AS", ",\ncnt AS", 1))
def q_ap(spark, sf):
    return M.average_precision(_scored(spark, sf))


@register("ml_precision_at_100", S + """
SELECT horizon, avg(CAST(y AS DOUBLE)) AS precision_at_100, count(*) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY p DESC, event_id) AS rn FROM scored
) WHERE rn <= 100 GROUP BY 1""")
def q_pat100(spark, sf):
    return M.precision_at_k(_scored(spark, sf), 100)


def _report_sql():
    def cls(name, tp, fp, fn):
        prec = f"CASE WHEN ({tp} + {fp}) > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0 END"
        rec = f"CASE WHEN ({tp} + {fn}) > 0 THEN {tp} / ({tp} + {fn}) ELSE 0.0 END"
        return (f"SELECT horizon, '{name}' AS class, {prec} AS precision, {rec} AS recall, "
                f"CASE WHEN ({prec}) + ({rec}) > 0 THEN 2.0 * ({prec}) * ({rec}) / (({prec}) + ({rec})) ELSE 0.0 END AS f1, "
                f"{tp} + {fn} AS support FROM g")
    return S + f"""
, g AS (SELECT horizon,
        CAST(sum(CASE WHEN p > 0.5 AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS tp,
        CAST(sum(CASE WHEN p > 0.5 AND y = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS fp,
        CAST(sum(CASE WHEN p <= 0.5 AND y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS fn,
        CAST(sum(CASE WHEN p <= 0.5 AND y = 0 THEN 1 ELSE 0 END) AS DOUBLE) AS tn
        FROM scored GROUP BY 1),
cls AS ({cls('0', 'tn', 'fn', 'fp')} UNION ALL {cls('1', 'tp', 'fp', 'fn')}),
c0 AS (SELECT * FROM cls WHERE class = '0'), c1 AS (SELECT * FROM cls WHERE class = '1')
SELECT * FROM cls
UNION ALL
SELECT horizon, 'macro avg', c0.precision * 0.5 + c1.precision * 0.5, c0.recall * 0.5 + c1.recall * 0.5,
       c0.f1 * 0.5 + c1.f1 * 0.5, c0.support + c1.support FROM c0 JOIN c1 USING (horizon)
UNION ALL
SELECT horizon, 'weighted avg',
       c0.precision * (c0.support / (c0.support + c1.support)) + c1.precision * (c1.support / (c0.support + c1.support)),
       c0.recall * (c0.support / (c0.support + c1.support)) + c1.recall * (c1.support / (c0.support + c1.support)),
       c0.f1 * (c0.support / (c0.support + c1.support)) + c1.f1 * (c1.support / (c0.support + c1.support)),
       c0.support + c1.support FROM c0 JOIN c1 USING (horizon)""".replace("\n, g AS", ",\ng AS", 1)


@register("ml_classification_report", _report_sql())
def q_report(spark, sf):
    return M.classification_report(_scored(spark, sf))


@register("ml_recall_by_type", S + """
SELECT horizon, y_type AS error_type, count(*) AS n, avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END) AS recall,
       count(*) >= 10 AND avg(CASE WHEN p > 0.5 THEN 1.0 ELSE 0.0 END) < 0.35 AS missed
FROM scored WHERE y = 1 GROUP BY 1, 2""")
def q_recall_type(spark, sf):
    return M.recall_by_type(_scored(spark, sf))


@register("ml_reliability_bins", S + """
SELECT horizon, CAST(floor(p * 10) AS INT) AS bin, count(*) AS n, avg(CAST(y AS DOUBLE)) AS actual_rate,
       avg(p) AS mean_p FROM scored WHERE p < 1.0 GROUP BY 1, 2""")
def q_reliability(spark, sf):
    return M.reliability_bins(_scored(spark, sf))


@register("ml_score_histogram", S + """
SELECT horizon, CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS count FROM scored GROUP BY 1, 2""")
def q_hist(spark, sf):
    return M.score_histogram(_scored(spark, sf))


@register("ml_pos_weights", S + """
SELECT horizon, sum(y) AS pos, sum(1 - y) AS neg,
       least(sum(1 - y) / greatest(sum(y), 1), CASE WHEN horizon = 15 THEN 20.0 ELSE 10.0 END) AS pos_weight
FROM scored GROUP BY 1""")
def q_pos_weights(spark, sf):
    return M.pos_weights(_scored(spark, sf))


@register("ml_focal_loss", S + f"""
, pw AS (SELECT horizon, least(sum(1 - y) / greatest(sum(y), 1), CASE WHEN horizon = 15 THEN 20.0 ELSE 10.0 END) AS pos_weight
         FROM scored GROUP BY 1),
x AS (SELECT s.*, pw.pos_weight, least(greatest(p, {d(1e-7)}), {d(1 - 1e-7)}) AS pc, CAST(y AS DOUBLE) AS yd
      FROM scored s JOIN pw USING (horizon)),
l AS (SELECT horizon, -(yd * ln(pc) + (1.0 - yd) * ln(1.0 - pc)) AS bce,
             yd * pc + (1.0 - yd) * (1.0 - pc) AS pt, CASE WHEN yd = 1 THEN pos_weight ELSE 1.0 END AS w FROM x)
SELECT horizon, avg(pow(1.0 - pt, 2.0) * bce * w) AS focal_loss, avg(bce) AS bce FROM l GROUP BY 1""".replace(
    "\n, pw AS", ",\npw AS", 1))
def q_focal(spark, sf):
    s = reliable_checkpoint(_scored(spark, sf).select("horizon", "p", "y"))  # read for the weights and for the loss
    return M.focal_loss(s, M.pos_weights(s))


def _temp_sql():
    grid = M.temperature_grid()
    eps = 1e-7
    lg = f"ln(least(greatest(p, {d(eps)}), {d(1 - eps)}) / ({d(1.0)} - least(greatest(p, {d(eps)}), {d(1 - eps)})))"
    losses = []
    for t in grid:
        q = f"least(greatest({d(1.0)} / ({d(1.0)} + exp(-(lg / {d(t)}))), {d(eps)}), {d(1 - eps)})"
        losses.append(f"SELECT horizon, {t!r} AS temperature, avg(-(yd * ln({q}) + (1.0 - yd) * ln(1.0 - {q}))) AS loss "
                      f"FROM x GROUP BY 1")
    u = "\nUNION ALL\n".join(losses)
    return S + f""", x AS (SELECT horizon, CAST(y AS DOUBLE) AS yd, {lg} AS lg FROM scored),
losses AS ({u})
SELECT horizon, arg_min(temperature, (loss, temperature)) AS temperature, min(loss) AS loss FROM losses GROUP BY 1"""


@register("ml_temperature", _temp_sql())
def q_temperature(spark, sf):
    return M.fit_temperature(_scored(spark, sf))


def _conformal_sql(alpha: float = 0.10):
    return S + f"""
, pos AS (SELECT event_id, row_number() OVER (ORDER BY "timestamp", event_id) - 1 AS pos FROM telemetry),
nn AS (SELECT count(*) AS n FROM telemetry),
sl AS (SELECT s.*, p.pos FROM scored s JOIN pos p USING (event_id)),
conf_cal AS (SELECT horizon, abs(CAST(y AS DOUBLE) - p) AS s FROM sl, nn
        WHERE pos >= floor(0.6::DOUBLE * n) AND pos < floor(0.8::DOUBLE * n)),
calr AS (SELECT horizon, s, row_number() OVER (PARTITION BY horizon ORDER BY s) - 1 AS r,
                count(*) OVER (PARTITION BY horizon) AS m FROM conf_cal),
lvl AS (SELECT DISTINCT horizon, m,
               (m - 1) * least(1.0::DOUBLE, ceil((m + 1) * (1.0::DOUBLE - {d(alpha)})) / m) AS h FROM calr),
qh AS (SELECT l.horizon, a.s + (b.s - a.s) * (l.h - floor(l.h)) AS q_hat
       FROM lvl l JOIN calr a ON a.horizon = l.horizon AND a.r = CAST(floor(l.h) AS BIGINT)
                  JOIN calr b ON b.horizon = l.horizon AND b.r = least(CAST(floor(l.h) AS BIGINT) + 1, l.m - 1)),
test AS (SELECT sl.*, q.q_hat FROM sl JOIN qh q USING (horizon), nn WHERE pos >= floor(0.8::DOUBLE * n)),
iv AS (SELECT horizon, q_hat, least(greatest(p - q_hat, 0.0), 1.0) AS lo, least(greatest(p + q_hat, 0.0), 1.0) AS hi,
              CAST(y AS DOUBLE) AS yd FROM test)
SELECT horizon, q_hat, avg(CASE WHEN yd >= lo AND yd <= hi THEN 1 ELSE 0 END) AS coverage, avg(hi - lo) AS avg_width,
       count(*) AS n, avg(CASE WHEN yd >= lo AND yd <= hi THEN 1 ELSE 0 END) >= {1 - alpha!r} AS pass
FROM iv GROUP BY horizon, q_hat""".replace("\n, pos AS", ",\npos AS", 1)


@register("ml_conformal_coverage", _conformal_sql())
def q_conformal(spark, sf, alpha: float = 0.10):
    # the scored table feeds a count, the order-statistics passes and the
    # interval pass: materialise it (and the calibration slice) once
    s = reliable_checkpoint(_scored(spark, sf))
    pos = reliable_checkpoint(chrono_positions(spark, sf))
    n = FX.telemetry(spark, sf).count()
    cal = reliable_checkpoint(chrono_slice(s, pos, n, 0.6, 0.8))
    test = chrono_slice(s, pos, n, 0.8, 1.0)
    qs = [(h, float(M.conformal_q(cal.filter(F.col("horizon") == h), alpha))) for h in HORIZONS]
    qdf = spark.createDataFrame(qs, "horizon int, q_hat double")     # one row per horizon
    iv = M.intervals(test.join(F.broadcast(qdf), "horizon"), F.col("q_hat"))
    cov = M.coverage(iv, alpha, by=("horizon", "q_hat"))
    return cov.select("horizon", "q_hat", "coverage", "avg_width", "n", "pass")


@register("ml_prediction_table", S + """
, g AS (SELECT event_id, api_name, "timestamp",
        max(CASE WHEN horizon = 1 THEN p END) AS p_h1, max(CASE WHEN horizon = 5 THEN p END) AS p_h5,
        max(CASE WHEN horizon = 15 THEN p END) AS p_h15, max(CASE WHEN horizon = 1 THEN y END) AS actual_h1
        FROM scored GROUP BY 1, 2, 3)
SELECT *, (p_h1 + p_h5 + p_h15) / 3.0 AS p_mean,
       CASE WHEN (p_h1 + p_h5 + p_h15) / 3.0 >= 0.65 THEN 'HIGH' WHEN (p_h1 + p_h5 + p_h15) / 3.0 >= 0.35 THEN 'MEDIUM'
            ELSE 'LOW' END AS risk FROM g""".replace("\n, g AS", ",\ng AS", 1))
def q_pred_table(spark, sf):
    return SG.prediction_table(_scored(spark, sf))


@register("ml_quality_gate", _auc_ctes("horizon") + f"""
SELECT avg(auc) AS avg_auc, avg(auc) >= {C.AUC_FLOOR} AS pass FROM auc_t""")
def q_gate(spark, sf):
    return M.quality_gate(M.roc_auc(_scored(spark, sf)), C.AUC_FLOOR)


@register("ml_driver_ranking", S + """
, dr AS (SELECT event_id, 'Error rate' AS driver, 9.0::DOUBLE * error_rate_rolling AS value FROM sc0
  UNION ALL SELECT event_id, 'Response time', 0.55::DOUBLE * ln(greatest(1.0::DOUBLE, rt_multiplier)) FROM sc0
  UNION ALL SELECT event_id, 'Error volatility', 1.6::DOUBLE * error_volatility FROM sc0
  UNION ALL SELECT event_id, 'Recent failures', 0.18::DOUBLE * recent_failures FROM sc0
  UNION ALL SELECT event_id, 'Load stress', 0.45::DOUBLE * greatest(0.0::DOUBLE, burst_ratio - 1.2::DOUBLE) FROM sc0
  UNION ALL SELECT event_id, 'API profile', """ + "COALESCE(CASE api_name " + " ".join(
    f"WHEN '{k}' THEN {float(v)!r}::DOUBLE" for k, v in C.SURROGATE_API_BIAS.items()) + """ END, 0.0::DOUBLE) FROM sc0),
r AS (SELECT event_id, driver, round_even(value * 1000.0, 0) / 1000.0 AS value FROM dr)
SELECT event_id, driver, value,
       row_number() OVER (PARTITION BY event_id ORDER BY abs(value) DESC, driver) AS rank,
       CASE WHEN max(abs(value)) OVER (PARTITION BY event_id) > 0
            THEN abs(value) / max(abs(value)) OVER (PARTITION BY event_id) ELSE 0.0 END AS share_of_max
FROM r""".replace("\n, dr AS", ",\ndr AS", 1))
def q_drivers(spark, sf):
    return SG.rank_drivers(scored_wide(spark, sf))

"""Evaluation on the long scored table (ML-08, ML-09, ML-13..25, ML-29, ML-30, ML-32).

Input schema: (..., horizon, p, y[, y_type]).  Rank metrics first aggregate to
distinct scores (map-side partial aggregation), then use distributed prefix
sums (``series.cumulative``) — never an un-partitioned window over raw rows.
Ties are handled exactly (average-rank AUC; step-wise average precision).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.scalars import logit, sigmoid
from faultline.operators import series


def _by(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def score_counts(scored: DataFrame, by=("horizon",), score: str = "p", label: str = "y") -> DataFrame:
    return (scored.groupBy(*_by(by), F.col(score).alias("score"))
            .agg(F.sum(F.col(label).cast("long")).alias("pos"),
                 F.sum((F.lit(1) - F.col(label)).cast("long")).alias("neg")))


def roc_auc(scored: DataFrame, by=("horizon",), score: str = "p", label: str = "y") -> DataFrame:
    """ML-13 / ML-18: exact ROC-AUC (Mann–Whitney with half credit for ties);
    NULL when a group has a single class."""
    by = _by(by)
    cnt = score_counts(scored, by, score, label)
    cum = series.cumulative(cnt, by, ["score"], ["neg"])
    part = cum.select(*by, "pos", "neg",
                      (F.col("pos").cast("double") * (F.col("cum_neg").cast("double")
                                                      - F.col("neg").cast("double") / F.lit(2.0))).alias("u"))
    g = part.groupBy(*by).agg(F.sum("u").alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    auc = F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                 F.col("u") / (F.col("n_pos").cast("double") * F.col("n_neg").cast("double")))
    return g.select(*by, auc.alias("auc"), "n_pos", "n_neg")


def roc_curve(scored: DataFrame, by=("horizon",), score: str = "p", label: str = "y") -> DataFrame:
    """ML-14: (fpr, tpr) at every distinct threshold (score >= threshold)."""
    by = _by(by)
    cnt = score_counts(scored, by, score, label)
    cum = series.cumulative(cnt, by, ["score"], ["pos", "neg"], desc=True)
    tot = cnt.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    j = cum.join(F.broadcast(tot), by)
    return j.select(*by, F.col("score").alias("threshold"),
                    F.when(F.col("N") > 0, F.col("cum_neg") / F.col("N")).alias("fpr"),
                    F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P")).alias("tpr"))


def average_precision(scored: DataFrame, by=("horizon",), score: str = "p", label: str = "y") -> DataFrame:
    """ML-15: step-wise AP = sum_k (R_k - R_{k-1}) * P_k over descending
    distinct thresholds."""
    by = _by(by)
    cnt = score_counts(scored, by, score, label).withColumn("tot", F.col("pos") + F.col("neg"))
    cum = series.cumulative(cnt, by, ["score"], ["pos", "tot"], desc=True)
    g = cum.groupBy(*by).agg(
        F.sum(F.col("pos").cast("double") * F.col("cum_pos").cast("double") / F.col("cum_tot").cast("double"))
        .alias("_s"), F.sum("pos").alias("n_pos"))
    return g.select(*by, F.when(F.col("n_pos") > 0, F.col("_s") / F.col("n_pos")).alias("average_precision"),
                    "n_pos")


def precision_at_k(scored: DataFrame, k: int = 100, by=("horizon",), score: str = "p", label: str = "y",
                   tie: str = "event_id") -> DataFrame:
    """ML-16 / TOP-05: mean label of the top-k scores (ties by id).  The
    ``row_number() <= k`` filter is planned as a per-partition group limit
    before the shuffle, so only k rows per task and group move."""
    by = _by(by)
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    top = scored.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return top.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias(f"precision_at_{k}"),
                                F.count(F.lit(1)).alias("k"))


def classification_report(scored: DataFrame, threshold: float = 0.5, by=("horizon",),
                          score: str = "p", label: str = "y") -> DataFrame:
    """ML-17: per-class precision/recall/F1/support plus macro and weighted rows."""
    by = _by(by)
    pred = (F.col(score) > threshold).cast("int")
    y = F.col(label).cast("int")
    g = scored.groupBy(*by).agg(
        F.sum(((pred == 1) & (y == 1)).cast("long")).alias("tp"),
        F.sum(((pred == 1) & (y == 0)).cast("long")).alias("fp"),
        F.sum(((pred == 0) & (y == 1)).cast("long")).alias("fn"),
        F.sum(((pred == 0) & (y == 0)).cast("long")).alias("tn"))

    def cls(name, tp, fp, fn):
        prec = F.when((tp + fp) > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
        rec = F.when((tp + fn) > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
        f1 = F.when((prec + rec) > 0, F.lit(2.0) * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
        return F.struct(F.lit(name).alias("class"), prec.alias("precision"), rec.alias("recall"),
                        f1.alias("f1"), (tp + fn).alias("support"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    c1 = cls("1", tp, fp, fn)
    c0 = cls("0", tn, fn, fp)
    rows = g.select(*by, c0.alias("c0"), c1.alias("c1"))
    tot = F.col("c0.support") + F.col("c1.support")

    def avg_row(name, w0, w1):
        return F.struct(F.lit(name).alias("class"),
                        *[(F.col(f"c0.{m}") * w0 + F.col(f"c1.{m}") * w1).alias(m)
                          for m in ("precision", "recall", "f1")],
                        tot.alias("support"))
    macro = avg_row("macro avg", F.lit(0.5), F.lit(0.5))
    weighted = avg_row("weighted avg", F.col("c0.support") / tot, F.col("c1.support") / tot)
    return rows.select(*by, F.explode(F.array("c0", "c1", macro, weighted)).alias("r")).select(*by, "r.*")


def recall_by_type(scored: DataFrame, threshold: float = 0.5, min_n: int = 10, floor: float = 0.35,
                   by=("horizon",), type_col: str = "y_type", score: str = "p", label: str = "y") -> DataFrame:
    """ML-19: recall per failure type; 'missed' when n >= min_n and recall < floor."""
    by = _by(by)
    pos = scored.filter(F.col(label) == 1)
    g = pos.groupBy(*by, F.col(type_col).alias("error_type")).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(score) > threshold).cast("double")).alias("recall"))
    return g.withColumn("missed", (F.col("n") >= min_n) & (F.col("recall") < floor))


def temperature_grid(lo: float = 0.5, hi: float = 3.0, step: float = 0.05) -> list[float]:
    n = int(round((hi - lo) / step))
    return [round(lo + i * step, 10) for i in range(n + 1)]


def fit_temperature(scored: DataFrame, grid=None, by=("horizon",), score: str = "p", label: str = "y",
                    eps: float = 1e-7) -> DataFrame:
    """ML-20: T minimising mean BCE(sigmoid(logit(p)/T), y) over a grid — all
    grid losses are aggregates of one pass (no row expansion)."""
    by = _by(by)
    grid = grid or temperature_grid()
    lg = logit(F.col(score), eps)
    y = F.col(label).cast("double")

    def bce(t):
        q = F.least(F.greatest(sigmoid(lg / F.lit(t)), F.lit(eps)), F.lit(1 - eps))
        return -(y * F.log(q) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - q))
    g = scored.groupBy(*by).agg(*[F.avg(bce(t)).alias(f"t{i}") for i, t in enumerate(grid)])
    long = g.select(*by, F.explode(F.array(*[
        F.struct(F.lit(t).alias("temperature"), F.col(f"t{i}").alias("loss")) for i, t in enumerate(grid)
    ])).alias("r")).select(*by, "r.*")
    return long.groupBy(*by).agg(F.min_by("temperature", F.struct("loss", "temperature")).alias("temperature"),
                                 F.min("loss").alias("loss"))


# --- conformal --------------------------------------------------------------------------
def conformal_level(n: int, alpha: float) -> float:
    return min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)


def conformal_q(cal: DataFrame, alpha: float = 0.10, score: str = "p", label: str = "y") -> float:
    """ML-21: q-hat = linear-interpolated quantile of |y - p| at
    min(1, ceil((n+1)(1-alpha))/n), via exact distributed order statistics."""
    s = cal.select(F.abs(F.col(label).cast("double") - F.col(score)).alias("s"))
    n = s.count()
    if n == 0:
        return float("nan")
    h = (n - 1) * conformal_level(n, alpha)
    lo = int(math.floor(h))
    hi = min(lo + 1, n - 1)
    vals = series.kth_values(s, "s", sorted({lo, hi}))
    a, b = vals[lo], vals[hi]
    return a + (b - a) * (h - lo)


def intervals(test: DataFrame, q_hat: Column | float, score: str = "p", label: str = "y") -> DataFrame:
    """ML-22: clip(p ± q, 0, 1), covered flag and width."""
    q = q_hat if isinstance(q_hat, Column) else F.lit(q_hat)
    lo = F.least(F.greatest(F.col(score) - q, F.lit(0.0)), F.lit(1.0))
    hi = F.least(F.greatest(F.col(score) + q, F.lit(0.0)), F.lit(1.0))
    y = F.col(label).cast("double")
    return test.select("*", lo.alias("lower"), hi.alias("upper"),
                       ((y >= lo) & (y <= hi)).cast("int").alias("covered"), (hi - lo).alias("width"))


def coverage(iv: DataFrame, alpha: float = 0.10, by=("horizon",), rule: str = "min") -> DataFrame:
    """ML-23: coverage, mean width, PASS (rule 'min': cov >= 1-alpha; 'band': |cov-(1-alpha)| < .05)."""
    by = _by(by)
    g = iv.groupBy(*by).agg(F.avg("covered").alias("coverage"), F.avg("width").alias("avg_width"),
                            F.count(F.lit(1)).alias("n"))
    ok = (F.col("coverage") >= 1 - alpha) if rule == "min" else (F.abs(F.col("coverage") - (1 - alpha)) < 0.05)
    return g.withColumn("pass", ok)


def reliability_bins(scored: DataFrame, n_bins: int = 10, by=("horizon",), score: str = "p",
                     label: str = "y", min_rows: int = 0) -> DataFrame:
    """ML-24: equal-width bins [lo, hi); p == 1 falls outside every bin."""
    by = _by(by)
    b = F.floor(F.col(score) * n_bins).cast("int")
    g = (scored.filter(F.col(score) < 1.0).groupBy(*by, b.alias("bin"))
         .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("actual_rate"),
              F.avg(F.col(score)).alias("mean_p")))
    return g.filter(F.col("n") > min_rows) if min_rows else g


def score_histogram(scored: DataFrame, n_bins: int = 10, by=("horizon",), score: str = "p") -> DataFrame:
    """ML-25: histogram with the last bin closed."""
    by = _by(by)
    b = F.least(F.floor(F.col(score) * n_bins), F.lit(n_bins - 1)).cast("int")
    return scored.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


# --- losses / weights -------------------------------------------------------------------
def pos_weights(scored: DataFrame, cap: float = 10.0, long_cap: float = 20.0, long_h: int = 15,
                by=("horizon",), label: str = "y") -> DataFrame:
    """ML-08: min(neg / max(1, pos), cap); cap doubled for the long horizon."""
    by = _by(by)
    g = scored.groupBy(*by).agg(F.sum(F.col(label).cast("long")).alias("pos"),
                                F.sum((F.lit(1) - F.col(label)).cast("long")).alias("neg"))
    c = F.when(F.col("horizon") == long_h, F.lit(long_cap)).otherwise(F.lit(cap)) if "horizon" in by else F.lit(cap)
    return g.withColumn("pos_weight", F.least(F.col("neg") / F.greatest(F.col("pos"), F.lit(1)), c))


def focal_loss(scored: DataFrame, weights: DataFrame | None = None, gamma: float = 2.0, by=("horizon",),
               score: str = "p", label: str = "y", eps: float = 1e-7) -> DataFrame:
    """ML-09: mean of (1-p_t)^gamma * BCE * w, w = pos_weight on positives."""
    by = _by(by)
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    bce = -(y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))
    pt = y * p + (F.lit(1.0) - y) * (F.lit(1.0) - p)
    df = scored.join(F.broadcast(weights.select(*by, "pos_weight")), by) if weights is not None \
        else scored.withColumn("pos_weight", F.lit(1.0))
    w = F.when(y == 1, F.col("pos_weight")).otherwise(F.lit(1.0))
    fl = F.pow(F.lit(1.0) - pt, F.lit(gamma)) * bce * w
    return df.groupBy(*by).agg(F.avg(fl).alias("focal_loss"), F.avg(bce).alias("bce"))


# --- selection ----------------------------------------------------------------------------
def compare_models(metrics: DataFrame, model: str = "model", metric: str = "auc",
                   candidate: str = "candidate") -> DataFrame:
    """ML-29: best baseline and the candidate's % improvement over it."""
    base = metrics.filter(F.col(model) != candidate)
    best = base.agg(F.max_by(model, metric).alias("best_baseline"), F.max(metric).alias("best_auc"))
    cand = metrics.filter(F.col(model) == candidate).select(F.max(metric)).scalar()
    return best.withColumn("candidate_auc", cand).withColumn("improvement_pct",
                        F.lit(100.0) * (F.col("candidate_auc") - F.col("best_auc")) / F.col("best_auc"))


def accept(old: Column, new: Column, min_gain: float = 0.001) -> Column:
    """ML-30: promote iff new - old >= min_gain and new is a number."""
    return new.isNotNull() & ~F.isnan(new) & ((new - F.coalesce(old, F.lit(float("-inf")))) >= min_gain)


def quality_gate(metrics: DataFrame, floor: float = 0.70, metric: str = "auc") -> DataFrame:
    """ML-32: pass iff mean metric (NaN/NULL ignored) >= floor."""
    m = F.avg(F.when(~F.isnan(metric), F.col(metric)))
    return metrics.agg(m.alias(f"avg_{metric}")).withColumn("pass", F.col(f"avg_{metric}") >= floor)

"""Self-improvement loop (DR-06..08, DR-10..12): identify problems on a scored
pool, apply targeted fixes, retrain, compare, accept, and log the run.  Every
step is a Spark plan; only one-row summaries reach the driver."""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.operators import metrics as M
from faultline.operators import ml, quality, sampling
from faultline.session import reliable_checkpoint


def identify_problems(scored: DataFrame, pool: DataFrame, half_a: DataFrame, half_b: DataFrame) -> dict:
    """DR-06: worst API (h1 AUC), missed failure types, drift (KS), imbalance."""
    auc = M.roc_auc(scored.filter(F.col("horizon") == 1), by=("api_name",))
    worst = auc.filter(F.col("auc").isNotNull()).orderBy("auc", "api_name").first()
    missed = [r["error_type"] for r in M.recall_by_type(scored.filter(F.col("horizon") == 1))
              .filter("missed").select("error_type").collect()]        # bounded: one row per type
    ks = reliable_checkpoint(quality.ks_2samp(half_a, half_b, C.DRIFT_FEATURES))
    dec = quality.drift_decision(ks).first()
    rep = {r["feature"]: {"ks": r["ks"], "p": r["p_value"],
                          "drifted": bool(r["ks"] > C.KS_THRESHOLD and r["p_value"] < C.KS_P_THRESHOLD)}
           for r in ks.collect()}                                     # one row per drift feature
    imb = quality.imbalance(pool).first()
    return {"worst_api": worst["api_name"] if worst else None, "worst_api_auc": worst["auc"] if worst else None,
            "missed_failure_types": missed, "drift_detected": bool(dec["dataset_drift"]), "drift_report": rep,
            "imbalance_detected": bool(imb["imbalance"]), "failure_rate": imb["failure_rate"]}


def apply_fixes(pool: DataFrame, problems: dict, positions: DataFrame, n: int) -> tuple[DataFrame, list]:
    """DR-07: A recency window (last 65 %), B worst-API failures x5 (jittered,
    capped), C missed types x5, D failure injection towards 13 %.  Each fix counts
    and draws from the rows of the one before, so these are written."""
    fixes = []
    out = pool
    if problems["drift_detected"]:
        cut = int(n * (1 - C.DRIFT_WINDOW_FRACTION))
        out = reliable_checkpoint(out.join(positions.filter(F.col("pos") >= cut).select("event_id"), "event_id", "left_semi"))
        fixes.append("drift_recency_window")
    w = problems.get("worst_api")
    if w and problems.get("worst_api_auc") is not None and problems["worst_api_auc"] < C.AUC_FLOOR:
        out = sampling.augment_group(out, (F.col("api_name") == w) & (F.col("success") == 0), seed="worst")
        out = reliable_checkpoint(out.drop("copy"))
        fixes.append(f"oversample_worst_api:{w}")
    for et in problems.get("missed_failure_types", []):
        if et is None:
            continue
        out = reliable_checkpoint(sampling.augment_group(out, (F.col("error_type") == et) & (F.col("success") == 0),
                                                         scale=0.04, scale_step=0.0, seed=f"missed:{et}").drop("copy"))
        fixes.append(f"boost_missed_type:{et}")
    if problems["imbalance_detected"]:
        out = reliable_checkpoint(sampling.inject_failures(out).drop("copy"))
        fixes.append("inject_failures_for_imbalance")
    return out, fixes


def improvement_cycle(train_old: DataFrame, train_new: DataFrame, test: DataFrame, cols, run_id: str,
                      problems: dict, fixes: list, dry_run: bool = False) -> dict:
    """DR-08: retrain on the fixed pool, compare with the current model on the
    same test split (JN-15), accept iff the gain >= 0.001 (ML-30)."""
    rec = {"run_id": run_id, "timestamp": _dt.datetime(2024, 1, 31).isoformat(), "mode": "dry_run" if dry_run else "full",
           "problems_found": {k: problems[k] for k in ("drift_detected", "imbalance_detected", "worst_api",
                                                       "drift_report")},
           "fixes_applied": fixes}
    if dry_run:
        rec["comparison"] = {"old_auc": None, "new_auc": None, "delta": None}
        rec["outcome"] = {"promoted": False}
        return rec

    def auc(train):
        m = ml.fit_baseline(train, "lr", cols, "y")
        return M.roc_auc(ml.score(m, test, horizon=1)).first()["auc"]
    old, new = auc(train_old), auc(train_new)
    delta = None if (old is None or new is None) else new - old
    rec["comparison"] = {"old_auc": old, "new_auc": new, "delta": delta}
    rec["outcome"] = {"promoted": bool(new is not None and old is not None and new - old >= 0.001)}
    return rec


def heal_history(log: DataFrame, n: int = 5) -> DataFrame:
    """DR-11: the last n runs (newest last): drift, imbalance, #fixes, promoted, delta %."""
    last = log.orderBy(F.col("timestamp").desc(), F.col("run_id").desc()).limit(n)
    return last.select("run_id", "timestamp", F.col("problems_found.drift_detected").alias("drift"),
                       F.col("problems_found.imbalance_detected").alias("imbalance"),
                       F.size("fixes_applied").alias("n_fixes"), F.col("outcome.promoted").alias("promoted"),
                       (F.col("comparison.delta") * F.lit(100.0)).alias("delta_pct")).orderBy("timestamp", "run_id")


def snapshot(**tables: DataFrame) -> DataFrame:
    """DR-12: one JSON document nesting each (small) result table as an array
    of row structs."""
    parts = []
    for name, df in tables.items():
        parts.append(df.agg(F.collect_list(F.struct(*df.columns)).alias(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    merged = out.agg(*[F.max(F.to_json(F.col(n))).alias(n) for n in tables])
    return merged.select(F.concat(F.lit("{"), F.concat_ws(", ", *[
        F.concat(F.lit(json.dumps(n) + ": "), F.col(n)) for n in tables]), F.lit("}")).alias("snapshot"))

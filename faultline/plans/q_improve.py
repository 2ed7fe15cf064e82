"""Registered queries: the self-improvement loop and its reports (DR-06..12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from faultline import constants as C
from faultline.operators import improve, quality, surrogate
from faultline.operators import metrics as M
from faultline.plans.catalog import register
from faultline.plans.q_models import FEATS, training_frame
from faultline.plans.q_quality import _halves
from faultline.plans.scored import HORIZONS, chrono_positions, labelled_features, scored_long
from faultline.session import reliable_checkpoint, scratch_dir
from faultline.sources import files
from faultline.sources import fixtures as FX


def _problems(spark, sf, wide):
    """``wide``: the features with their targets, which the scores, the halves and the
    training rows are all taken from."""
    # each input is materialised once: several one-row summaries read them
    scored = surrogate.to_long(surrogate.surrogate_forecast(wide), HORIZONS)
    s = reliable_checkpoint(scored.join(FX.telemetry(spark, sf).select("event_id", "success"), "event_id"))
    a, b = _halves(spark, sf, wide)
    pool = FX.telemetry(spark, sf)
    return improve.identify_problems(s, pool, a, b)


@register("dr_identify_problems")
def q_identify(spark, sf):
    p = _problems(spark, sf, reliable_checkpoint(labelled_features(spark, sf)))
    return spark.createDataFrame(
        [(p["worst_api"], p["worst_api_auc"], len(p["missed_failure_types"]), p["drift_detected"],
          p["imbalance_detected"], p["failure_rate"])],
        "worst_api string, worst_api_auc double, n_missed_types int, drift_detected boolean, "
        "imbalance_detected boolean, failure_rate double")


@register("dr_improvement_cycle")
def q_cycle(spark, sf):
    """DR-07/08 + SNK-05 + SRC-08 + DR-11: a dry run and a full run appended to
    a JSONL run log, read back tolerantly, reported as heal history."""
    import json
    wide = reliable_checkpoint(labelled_features(spark, sf))
    p = _problems(spark, sf, wide)
    d = reliable_checkpoint(training_frame(spark, sf, wide.drop("recent_failures")))
    train, test = d.filter("split = 'train'"), d.filter("split = 'test'")
    fixed, fixes = improve.apply_fixes(train, p, chrono_positions(spark, sf), FX.telemetry(spark, sf).count())
    fixed = fixed.withColumn("y", F.coalesce(F.col("y"), (F.lit(1) - F.col("success")).cast("double")))
    path = scratch_dir(spark, "heal_log")
    for rid, dry in (("run-1-dry", True), ("run-2-full", False)):
        rec = improve.improvement_cycle(train, fixed, test, FEATS, rid, p, fixes, dry)
        df = spark.read.schema(files.HEAL_LOG_SCHEMA).json(spark.sparkContext.parallelize([json.dumps(rec)]))
        files.append_audit_jsonl(df, path)
    log = files.read_heal_log(spark, path)
    return improve.heal_history(log, 5)


@register("dr_slo_budget")
def q_slo(spark, sf):
    """DR-10 over the conformal coverage per horizon."""
    from faultline.plans.q_evaluation import q_conformal
    return quality.slo_budget(q_conformal(spark, sf), "coverage", 0.90)


@register("dr_results_snapshot")
def q_snapshot(spark, sf):
    """DR-12: metrics, policy and heal summaries nested into one JSON document."""
    from faultline.plans.q_decisions import q_policy_metrics
    s = scored_long(spark, sf)
    return improve.snapshot(auc=M.roc_auc(s), average_precision=M.average_precision(s),
                            policies=q_policy_metrics(spark, sf))

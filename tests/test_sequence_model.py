"""The sequence model's written scores, judged by SQL; windows against plain slices."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.operators import metrics, ml, ordering
from faultline.plans import q_models
from faultline.session import scratch_dir
from faultline.sources import fixtures as FX

from conftest import SF0001


def test_windows_equal_plain_slices(spark):
    t = FX.telemetry(spark, SF0001)
    got = {r.event_id: r for r in ordering.sequences(t, ["response_time", "success"], 7, 3, (1, 5)).collect()}
    n = 0
    for (api,) in t.select("api_name").distinct().collect():
        rows = sorted(((r.timestamp, r.event_id, r.response_time, r.success) for r in t.where(F.col("api_name") == api).collect()))
        x = np.array([r[2:] for r in rows])
        for i in range(0, len(rows) - 6, 3):
            r, last = got[rows[i + 6][1]], i + 6
            n += 1
            assert np.array_equal(np.array(r.window), x[i: i + 7])
            assert (r.y_h1, r.y_h5) == tuple(1 - int(x[last + h, 1]) if last + h < len(x) else None for h in (1, 5))
    assert n == len(got)


def test_auc_of_written_scores_by_sql(spark):
    d = q_models.sequence_frame(spark, SF0001)
    cols = [f"{c}_{k}" for c in C.FEATURE_COLS for k in ("mean", "last", "slope")]
    assert set(cols) <= set(d.columns) and d.where("part = 'train'").count() > 400
    scored = ml.score_multi(ml.fit_multi_horizon(d.filter("part = 'train'"), cols, kind="lr"), d.filter("part = 'test'"))
    path = scratch_dir(spark, "scores")
    scored.write.parquet(path)
    want = {r.horizon: r.auc for r in metrics.roc_auc(spark.read.parquet(path)).collect()}
    sql = duckdb.sql(f"""SELECT a.horizon, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END)
                         FROM '{path.removeprefix('file:')}/*.parquet' a JOIN '{path.removeprefix('file:')}/*.parquet' b USING (horizon) WHERE a.y = 1 AND b.y = 0 GROUP BY 1""").fetchall()
    assert set(want) == {1, 5, 15} == {h for h, _ in sql}
    assert all(abs(want[h] - auc) < 1e-9 for h, auc in sql)

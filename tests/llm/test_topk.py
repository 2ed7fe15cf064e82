import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import topk


def brute(rows, k, step):
    ok = [(i, [int(np.floor(256 * float(np.float64(x)))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in ok:
        if i % step == 0:
            s = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v)))[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("tile,shard,block", [(4096, 4096, 512), (3, 7, 2)])
def test_matches_brute_force(spark, tile, shard, block):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4), 1)]) for i in range(90)]
    rows += [(100 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(40)]  # ties
    rows += [(200, None), (201, [1.0, None, 1.0, 1.0]), (202, [1.0, float("nan"), 0.0, 0.0]), (203, [float("inf")] * 4), (None, [1.0] * 4),
             (205, []), (210, [1.0, 2.0]), (211, [3.0, 4.0]), (30, [0.5, 0.5, 0.5, 0.5]), (40, [3e8, -3e8, 1e8, 7.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, query int")
    got = topk.topk_search(df, F.col("vec_id") % 10 == 0, 5, tile_rows=tile, shard_rows=shard, block_rows=block, fan_in=3)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 10)
    assert topk.topk_search(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []

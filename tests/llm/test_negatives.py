import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import negatives


def brute(rows, every, n_pos=5, n_neg=10, low=30, high=90):
    ok = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows
          if None not in (i, lab, v) and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, lab, v in ok:
        if i % every:
            continue
        s = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in ok if j != i and len(v) == len(w)]
        for p, pid, _ in sorted(x for x in s if x[2] == lab)[:n_pos]:
            hits = sorted(x for x in s if x[2] != lab and low * -p <= 100 * -x[0] <= high * -p)[:n_neg]
            out += [(i, pid, r + 1, j, -p, -x) for r, (x, j, _) in enumerate(hits)]
    return sorted(out)


def rows():
    rng = np.random.default_rng(5)
    out = [(i, [float(x) for x in np.round(rng.normal(size=4) + 0.7, 1)], int(rng.integers(3))) for i in range(220)]
    out += [(300 + i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(60)]  # ties in score
    out += [(400 + i, [1.0, 1.0, 1.0, 1.0], 1) for i in range(80)]  # a hot label
    return out + [(600, None, 1), (610, [1.0, None, 1.0, 1.0], 1), (620, [1.0, float("nan"), 0.0, 0.0], 1), (630, [float("inf")] * 4, 1),
                  (None, [1.0] * 4, 1), (640, [1.0] * 4, None), (650, [], 1), (651, [], 2), (660, [1.0, 2.0], 1), (661, [2.0, 2.0], 1), (662, [1.0, 1.0], 2),
                  (30, [0.5, 0.5, 0.5, 0.5], 1), (30, [0.5, 0.5, 0.5, 0.5], 1), (310, [0.5, 0.5, 0.5, 0.5], 0), (670, [0.0] * 4, 1), (680, [-1.0] * 4, 2),
                  (690, [3e6, -3e6, 1e6, 7.0], 1), (691, [3e6, -2e6, 1e6, 7.0], 1), (692, [2e6, -2e6, 1e6, 7.0], 2)]


@pytest.mark.parametrize("tile,shard,block,fan", [(2048, 4096, 256, 16), (7, 23, 4, 3)])
def test_matches_brute_force(spark, tile, shard, block, fan):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows()], "vec_id long, embedding array<double>, label int, id int, t int")
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, tile_rows=tile, shard_rows=shard, block_rows=block, fan_in=fan)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows(), 10)


def test_windows_that_are_equal_or_empty(spark):
    data = [(0, [1.0], 0), (1, [1.0], 0), (2, [1.0], 0), (3, [0.0], 0), (5, [-1.0], 0), (10, [0.9], 1), (11, [0.5], 1), (12, [0.3], 1), (13, [0.2], 1), (14, [0.0], 1), (15, [-0.9], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r) for r in negatives.mine(df, F.col("vec_id") == 0, negatives=2).collect())
    assert got == brute(data, 100, n_neg=2) and {r[1] for r in got} == {1, 2, 3}
    assert negatives.mine(df.limit(0), F.col("vec_id") == 0).collect() == []
    assert negatives.mine(df, F.col("vec_id") == 99).collect() == []


def test_slots_are_disjoint_and_cover_all_scores_below_the_highest_limit():
    limits = np.array([[9, 5, 5, negatives.LONG.min, negatives.LONG.min]])
    s = np.array([[10, 9, 6, 5, 0, -4]])
    no = np.zeros_like(s, bool)
    r, slot, c = negatives._by_slot(s, no, no, limits, 10)
    assert dict(zip(c.tolist(), slot.tolist())) == {1: 0, 2: 0, 3: 2, 4: 2, 5: 2}

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.llm import lm


def tokens(text):
    return (text or "").encode().translate(lm.TO_LOWER).split() + [b" </s>"]


def brute(rows):
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    count, pairs = Counter(), Counter()
    for (d, t), h in zip(rows, held):
        if not h:
            w = tokens(t)
            count.update(w)
            pairs.update(zip([None] + w, w))
    n, v = sum(count.values()), len(count)
    near = lambda c: 0.75 * 2 ** c.bit_length() - 0.5 if c else 0.0
    out = []
    for (d, t), h in zip(rows, held):
        w = tokens(t)
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for a, b in zip([None] + w, w):
            before, both = near(count[a if a is not None else b" </s>"]), near(pairs[a, b])
            before = max(before, both)
            score += math.log10((both + lm.MU * (near(count[b]) + 1) / (n + v + 1)) / (before + lm.MU))
        out.append((d, h, len(w), sum(count[x] > 0 for x in w), n, base, score))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [8 << 20, 900])
def test_scores_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK_BYTES", chunk)
    rng = np.random.default_rng(1)
    rows = [(1, None), (2, ""), (2, ""), (None, "Null id WORD"), (3, "\n\t one É é ONE "), (4, " ".join(["long"] * 5000))]
    rows += [(10 + i, " ".join(f"w{int(x)}" for x in rng.zipf(1.5, int(rng.integers(1, 60))) % 200)) for i in range(120)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, tokens string")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = sorted([tuple(r) for r in lm.score_documents(df, held).collect()], key=str)
    want = brute(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12)
    # the filter's false positives may only lift a few counts
    close = np.isclose([g[6] for g in got], [w[6] for w in want], rtol=1e-9)
    assert close.mean() > 0.5 and np.allclose([g[6] for g in got], [w[6] for w in want], rtol=0.1, atol=2)
    assert lm.score_documents(df.limit(0), held).collect() == []


def test_filter_reads_back_levels():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 20000, dtype=np.uint64)
    c = rng.zipf(1.6, 20000).astype(np.int64)
    bits = int(lm.levels(c).sum() * lm.KEY_BITS * 1.4) // 8 * 8
    f = lm.Filter(lm.build(h, c, bits), 1, bits)
    want = 0.75 * 2.0 ** lm.levels(c) - 0.5
    assert (f.count(h) >= want).all() and (f.count(h) == want).mean() > 0.9
    other = rng.integers(0, 2**63, 20000, dtype=np.uint64)
    assert (f.count(other) > 0).mean() < 0.1
    small = lm.Filter(lm.build(h, c, bits // 8 // 8 * 8), 1, bits // 8 // 8 * 8)  # holds the frequent ones only
    top = c >= np.sort(c)[-50]
    assert (small.count(h[top]) >= want[top]).all()
    assert (small.count(other) > 0).mean() < 0.1


def test_held_out_text_scores_better_than_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    mixed = docs.where(held).select((F.col("doc_id") * 0 + 2).alias("doc_id"), F.array_join(F.shuffle(F.split("text", "[ \n]+"), seed=F.lit(1)), " ").alias("text"))
    both = docs.select("doc_id", "text")
    real = lm.score_documents(both, held).where("held_out").agg(F.sum("score") / F.sum("n_tokens"), F.sum("base_score") / F.sum("n_tokens")).first()
    test = both.withColumn("h", held).union(mixed.withColumn("h", F.lit(True)))
    out = lm.score_documents(test, F.col("h")).where("held_out").groupBy(F.col("doc_id") == 2).agg(F.sum("score") / F.sum("n_tokens")).collect()
    assert real[0] > real[1]  # pairs help over single words
    assert len(out) == 2


def test_every_training_pair_is_held_at_any_filter_bound(spark):
    """A bound far below what the pairs need makes more segments, not fewer pairs."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.integers(0, 400, 50))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    got = sorted([tuple(r) for r in lm.score_documents(df, held, filter_bytes=64).collect()], key=str)
    train = [(g[6], w[6]) for g, w in zip(got, brute(rows)) if not w[1]]
    assert np.allclose(*zip(*train), rtol=0.01)


def test_levels_read_over_many_segments():
    rng = np.random.default_rng(4)
    h = np.unique(rng.integers(0, 2**63, 5000, dtype=np.uint64))
    c = rng.zipf(1.6, len(h)).astype(np.int64) * (rng.random(len(h)) < 0.8)
    for bound in (1, 64, 1 << 20):
        got = lm.read_levels(h, c, bound)
        assert (got >= lm.levels(c)).all()
        assert (got == lm.levels(c)).mean() > 0.8

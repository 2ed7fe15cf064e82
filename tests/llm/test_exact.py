import random

import numpy as np
from pyspark.sql import functions as F

from faultline.llm import exact


def brute(rows):
    """rows: (doc_id, text) -> sorted (doc_id, keep_id, group_size, kept)"""
    groups = {}
    for n, (i, t) in enumerate(rows):
        t = t or ""
        groups.setdefault("".join(c for c in t if c not in " \t\n\x0b\x0c\r"), []).append((-len(t), i is None, i if i is not None else 0, n))
    out = []
    for g in groups.values():
        first = min(g)
        keep = None if first[1] else first[2]
        out += [(rows[n][0], keep, len(g), (s, a, i, n) == first) for s, a, i, n in g]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r._exact.keep_id, r._exact.group_size, r._exact.kept) for r in df.collect()), key=str)


def fixture():
    rng = random.Random(3)
    texts = ["", None, " \n", "a b", "ab", "a  b ", "ab ", "ab ", "x" * 50_000, " " + "x" * 50_000, "é\U0001f600", "é \U0001f600"]
    texts += [f"text {i}" for i in range(300)]
    rows = [(i, rng.choice(texts)) for i in range(500)] + [(7, "ab"), (7, "ab"), (None, "ab"), (None, None), (None, None), (None, "only null id")]
    return rows + [(1000 + i, "hot text") for i in range(400)]


def test_matches_brute_force_with_tiny_shards_and_overflow(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for options in ({}, {"shard_keys": 40, "buckets": 2, "max_kicks": 3}):
        assert got(exact.exact_dedup(df, ["doc_id"], **options)) == brute(rows)
    assert exact.exact_dedup(df.limit(0)).collect() == []


def test_shuffle_join_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = fixture()
    monkeypatch.setattr(exact, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(exact.exact_dedup(df, ["doc_id"])) == brute(rows)


def test_insert_and_delete(spark):
    rows = [(i, f"t{i % 40}") for i in range(200)] + [(500, "t3  "), (501, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = exact.build(df.where("doc_id < 100"), shard_keys=20, buckets=2, max_kicks=3)
    index = exact.insert(index, df.where("doc_id >= 100"))
    assert got(exact.decisions(index)) == brute(rows)
    out = [500, 501, 0, 1, *range(5, 200, 40)]  # a keeper, a lone text, group heads, a whole group
    index = exact.delete(index, spark.createDataFrame([(i,) for i in out], "x long"))
    left = [r for r in rows if r[0] not in out]
    assert got(exact.decisions(index)) == brute(left)
    assert index.entries.count() == len({t.replace(" ", "") for _, t in left})
    index = exact.insert(index, spark.createDataFrame([(501, "alone"), (5, "t5")], "doc_id long, text string"))
    assert got(exact.decisions(index)) == brute([*left, (501, "alone"), (5, "t5")])


def test_clashing_columns_are_returned(spark):
    df = spark.createDataFrame([(1, "a", 5, 6, 7, 8, 9), (2, "a ", 5, 6, 7, 8, 9)],
                               "doc_id long, text string, _exact int, key int, n int, _row int, _digest int")
    out = exact.exact_dedup(df)
    assert out.columns[:7] == df.columns
    assert [(r.doc_id, r.text, r.key, r.n, r._row, r._digest, r._exact, r._exact_.kept) for r in out.orderBy("doc_id").collect()] == [
        (1, "a", 6, 7, 8, 9, 5, False), (2, "a ", 6, 7, 8, 9, 5, True)]


def test_shard_filter_verifies_false_hits():
    """Keys with one fingerprint and one bucket are told apart by content; deleted slots are free again."""
    shard = exact.Shard(buckets=4, max_kicks=5)
    keys = np.array([[i << 40, 77, i, i] for i in range(1, 31)], np.uint64)
    keys[:, 0] = keys[:, 0] >> np.uint64(34)  # same low bits at first, told apart after growth
    vals = np.array([[1, 5, 0, i, i] for i in range(30)], np.int64)
    shard.add(keys[:20], vals[:20])
    assert shard.buckets > 4 and (shard.find(keys[:20])[0] >= 0).all() and (shard.find(keys[20:])[0] < 0).all()
    gone = vals[:10].copy()
    gone[:, 0] = 0
    shard.replace(keys[:10], gone)
    assert (shard.find(keys[:10])[0] < 0).all() and (shard.find(keys[10:20])[0] >= 0).all()
    shard.add(keys, vals)
    slots, stored, v = shard.rows()
    assert len(slots) == 30 and sorted(v[:, 0].tolist()) == [1] * 20 + [2] * 10
    again = exact.Shard(2)
    again.load(slots, stored, v, shard.buckets)
    assert (again.find(keys)[0] >= 0).all()


def test_query_over_the_table(spark):
    from faultline.llm.queries import QUERIES
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = QUERIES["op11_exact_dedup"](spark, sf)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out.collect()), key=str) == brute(rows)
    assert out.where(F.length("text_sha256") != 64).count() == 0

import numpy as np
import pytest

from faultline.llm import simhash


def brute(rows, shingle=3, bits=3):
    fps = [simhash.fingerprint(t, shingle) for _, t in rows]
    comp = list(range(len(rows)))
    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                comp[max(find(i), find(j))] = min(find(i), find(j))
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            best[r] = min(best.get(r, d), d)
    return sorted([(d, f"{fps[i]:016x}", best.get(find(i))) for i, (d, _) in enumerate(rows)], key=str)


def test_fingerprint_is_the_majority_of_hash_bits(spark):
    import pyspark.sql.functions as F
    text = "The Quick brown\tfox  jumps ÜBER the lazy dog the quick brown"
    words = "the quick brown fox jumps Über the lazy dog the quick brown".split(" ")
    sh = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)]
    hs = [r.h & (2**64 - 1) for r in spark.createDataFrame([(s,) for s in sh], "s string").select(F.xxhash64("s").alias("h")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
    assert simhash.fingerprint(text, 3) == want
    assert simhash.fingerprint(None, 3) == simhash.fingerprint(" \n", 3) == 0


def test_golay_neighbours_share_a_codeword():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 1 << 23, 3000)
    pos, code = simhash.nearby(w)
    own = [set() for _ in w]
    for p, c in zip(pos, code):
        own[p].add(c)
    for b in range(23):
        assert all(c in s for c, s in zip(simhash.decode(w ^ (1 << b)), own))
    assert {len(s) for s in own} == {1, 6}


def test_keys_meet_for_every_pair_within_three_bits():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.choice(64, i % 4, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    (pi, ki), _ = simhash.keys(a)
    _, (pp, kp) = simhash.keys(b)
    have = [set() for _ in a]
    for p, k in zip(pi, ki):
        have[p].add(k)
    met = np.zeros(len(a), bool)
    for p, k in zip(pp, kp):
        met[p] |= k in have[p]
    assert met.all()


@pytest.mark.parametrize("block", [2048, 3])
def test_components_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = [[f"w{x}" for x in rng.integers(0, 500, 300)] for _ in range(8)]
    rows = [(1, None), (2, ""), (None, "\n"), (3, "one"), (4, "one two"), (4, "one two"), (None, "only here and null id")]
    for i in range(160):
        w = list(base[i % 3 if i % 2 else i % 8])
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(0, len(w)))] = "changed"
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = sorted([(r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()], key=str)
    assert got == brute(rows)
    empty = simhash.simhash_components(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "fingerprint", "component_id"]


def test_dedup_keeps_one_row_of_each_component(spark):
    rng = np.random.default_rng(4)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 500, 200)) for _ in range(4)]
    rows = [(5, base[0]), (5, base[0]), (3, base[0]), (None, base[0]), (None, base[1]), (None, base[1]), (7, base[2]), (7, base[3]), (8, None), (9, "")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, root int")
    got = sorted([(r.doc_id, r.text) for r in simhash.simhash_dedup(df).collect()], key=str)
    assert got == sorted([(3, base[0]), (None, base[1]), (7, base[2]), (7, base[3]), (8, None)], key=str)
    assert simhash.simhash_dedup(df).columns == ["doc_id", "text", "root"]

"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits.  The perfect
binary Golay code [23, 12, 7] decodes any 23-bit word to the one codeword within
three bits, so a word and every word one bit away share a codeword if one side
also lists the codewords its one-bit neighbours decode to (1 or 6 in all).

Two fingerprints at three differing bits or fewer spread them over the three
segments so that either one segment agrees and another differs in at most one
bit (tables 0-5: exact segment + codeword), or each differs in exactly one bit
(table 6: three codewords).  Both kinds of key carry 30 bits and more.  One side
of the join (the index) holds the plain codeword, the other (the probe) the list.
Every pair that meets is verified by its true distance.

Pairs are never written out: a probe names the smallest index entry it matched,
and its other matches hang on that same entry, which keeps the components and
takes at most one row per member and hub.  Keys with very many index entries are
dealt over a grid of sub-keys, index blocks by probe blocks, so that no task
holds more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import LOWER, UPPER, broadcast_checked, fresh, written
from faultline.llm.graph import connected_components

SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, width
GENERATOR = 0b110001110101  # of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
#: Index entries of a key beyond which the key is dealt over a grid.
BLOCK = 2048
CHUNK = 1 << 20
LAST = (1 << 63) - 1
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, shingle: int) -> int:
    """SimHash over all shingles (repeats included) of the whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = min(shingle, len(words))
    pairs = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in pairs], dtype=">u8")
    votes = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[a: a + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), pa.array(fp.view(np.int64))], names=["doc_id", "t", "fp"])
    return run


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of every (11-bit part, 12-bit part) by halves, and the error of every syndrome."""
    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x
    unit = np.array([remainder(1 << b) for b in range(23)], dtype=np.int64)
    error = np.zeros(2048, np.int64)
    bits = range(23)
    for i in bits:
        error[unit[i]] = 1 << i
        for j in range(i):
            error[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    return unit, error


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 message bits) of the codeword within three bits of each 23-bit word."""
    unit, error = golay()
    syndrome = np.zeros(len(words), np.int64)
    for b in range(23):
        syndrome ^= np.where(words >> b & 1, unit[b], 0)
    return (words ^ error[syndrome]) >> 11


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, codeword index): the distinct codewords to which each word or a
    word one bit away decodes."""
    near = np.stack([decode(words)] + [decode(words ^ (1 << b)) for b in range(23)], axis=1)
    near.sort(axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    return np.nonzero(first)[0], near[first]


def _pairs(left: tuple, right: tuple, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (position, value of left, value of right) for two sorted listings of n positions."""
    (pa_, va), (pb, vb) = left, right
    count_b = np.bincount(pb, minlength=n)
    start_b = np.cumsum(count_b) - count_b
    reps = count_b[pa_]
    pos = np.repeat(pa_, reps)
    within = np.arange(len(pos)) - np.repeat(np.cumsum(reps) - reps, reps)
    return pos, np.repeat(va, reps), vb[start_b[pos] + within]


def keys(fps: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(index positions, keys), (probe positions, keys) of the fingerprints."""
    n, at = len(fps), np.arange(len(fps))
    seg = [(fps >> np.uint64(s) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    code = [decode(s) for s in seg]
    near = [nearby(s) for s in seg]
    index, probe, table = [], [], 0
    for i in range(3):
        for j in range(3):
            if i != j:
                index.append((at, table << 56 | seg[i] << 12 | code[j]))
                pos, value = near[j]
                probe.append((pos, table << 56 | seg[i][pos] << 12 | value))
                table += 1
    pos, value = near[2]
    index.append((pos, table << 56 | code[0][pos] << 24 | code[1][pos] << 12 | value))
    pos, a, b = _pairs(near[0], near[1], n)
    probe.append((pos, table << 56 | a << 24 | b << 12 | code[2][pos]))
    return tuple(tuple(np.concatenate(x) for x in zip(*side)) for side in (index, probe))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        for role, (pos, key) in enumerate(keys(fps)):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), role, np.int8)), pa.array(fps[pos].view(np.int64))],
                                             names=["key", "role", "fp"])


def _links(bits: int):
    def matched(i_fp, lo, hi, p_fp):
        """Hub edges of probes against index ranges [lo, hi), a bounded number at a time."""
        size = hi - lo
        cut = np.concatenate([[0], np.cumsum(size)])
        a = 0
        while a < len(p_fp):
            b = max(a + 1, int(np.searchsorted(cut, cut[a] + CHUNK, side="right")) - 1)
            n = size[a:b]
            who = np.repeat(np.arange(a, b), n)
            at = np.repeat(lo[a:b] - (cut[a:b] - cut[a]), n) + np.arange(int(n.sum()))
            ok = np.bitwise_count((i_fp[at] ^ p_fp[who]).view(np.uint64)) <= bits
            who, at = who[ok], at[ok]
            if len(who):
                hub = np.minimum.reduceat(i_fp[at], np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])))
                hub = np.repeat(hub, np.bincount(np.cumsum(np.concatenate([[0], (who[1:] != who[:-1])]).astype(np.int64))))
                e = np.concatenate([np.stack([hub, i_fp[at]], 1), np.stack([hub, p_fp[who]], 1)])
                e = e[e[:, 0] != e[:, 1]]
                if len(e):
                    e.sort(axis=1)
                    yield np.unique(e, axis=0)
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:  # sorted by key, index entries first
            key, role, fp = (batch.column(c).to_numpy() for c in ("key", "role", "fp"))
            keep = held_key == key[0]
            i_key = np.concatenate([held_key[keep], key[role == 0]])
            i_fp = np.concatenate([held_fp[keep], fp[role == 0]])
            p_key, p_fp = key[role == 1], fp[role == 1]
            lo, hi = np.searchsorted(i_key, p_key, "left"), np.searchsorted(i_key, p_key, "right")
            for e in matched(i_fp, lo, hi, p_fp):
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["a", "b"])
            last = i_key == key[-1]
            held_key, held_fp = i_key[last], i_fp[last]
    return run


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """Hub edges (a, b) that connect exactly the distinct fingerprints ``fp``
    which a chain of pairs at ``bits`` (3 at most) or fewer differing bits connects."""
    if bits > 3:
        raise ValueError("the tables find pairs at three differing bits or fewer")
    k = fps.mapInArrow(_keys, "key long, role tinyint, fp long")
    # keys with more index entries than a block: index blocks x probe blocks
    hot = written(k.where("role = 0").groupBy("key").count().where(F.col("count") > BLOCK)
                  .select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("side")), "simhash-hot")
    mine = F.pmod(F.xxhash64("fp"), F.col("side")).cast("int")
    every = F.sequence(F.lit(0), F.col("side") - 1)
    grid = F.when(F.col("side").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("p")))).otherwise(
        F.transform(every, lambda x: F.struct(F.when(F.col("role") == 0, mine).otherwise(x).alias("i"),
                                              F.when(F.col("role") == 0, x).otherwise(mine).alias("p"))))
    if hot.isEmpty():
        dealt = k
    else:
        dealt = (k.join(broadcast_checked(hot, 16), "key", "left").withColumn("cell", F.explode(grid))
                 .select(F.when(F.col("side").isNull(), F.col("key")).otherwise(F.xxhash64("key", "cell.i", "cell.p")).alias("key"), "role", "fp"))
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (dealt.repartition(parts, "key").sortWithinPartitions("key", "role")
            .mapInArrow(_links(bits), "a long, b long").distinct())


def _members(docs: DataFrame, shingle: int, bits: int) -> DataFrame:
    """doc_id, t (text hash), fp, root (a fingerprint that stands for the
    component) and component_id of every row."""
    text = F.col("text").cast("string")
    fps = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), text.alias("text"))
                  .mapInArrow(_fingerprints(shingle), "doc_id long, t long, fp long"), "simhash-fp")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    tree = connected_components(links(fps.select("fp").distinct(), bits))
    rooted = nodes.join(tree, nodes.fp == tree.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    member = written(rooted.join(named, "root").select("fp", "root", "component_id"), "simhash-member")
    return fps.join(member, "fp")


def simhash_components(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    Defined cases: a null or wordless text has fingerprint zero and is linked like
    any other; fewer words than a shingle form one shingle; rows with a null
    doc_id take part in links but never name a component (component_id is null
    if nothing reachable has an id); repeated rows give repeated results.
    """
    return _members(docs, shingle, bits).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the smallest doc_id (null ids
    last), of rows with one id the smallest text hash, of equal rows any one."""
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    rows = written(_members(docs, shingle, bits).select(d.alias("_d"), F.col("t").alias("_t"), "root"), "simhash-rows")
    best = rows.groupBy("root").agg(F.min(F.struct("_d", "_t")).alias("k"), F.count("*").alias("c")).where("c > 1")
    state = (rows.join(best, "root").groupBy("_d", "_t").agg(F.max((F.col("k._d") == F.col("_d")) & (F.col("k._t") == F.col("_t"))).alias("keep"),
                                                             F.count("*").alias("c")))
    state = written(state, "simhash-state")
    at = fresh(docs, "_d", "_t")
    base = docs.withColumn(at[0], d).withColumn(at[1], F.xxhash64(F.col("text").cast("string")))
    gone = broadcast_checked(state.where("not keep").select("_d", "_t").toDF(*at), 24)
    repeated = broadcast_checked(state.where("keep and c > 1").select("_d", "_t").toDF(*at), 24)
    left = base.join(gone, at, "left_anti")
    once = left.join(repeated, at, "left_anti")
    one_of = left.join(repeated, at, "left_semi").dropDuplicates(at)
    return once.unionByName(one_of).select(*[f"`{c}`" for c in docs.columns])

"""Language-model scores from a log-frequency Bloom filter.

Documents are packed, some megabytes of text to a chunk, into token numbers and
the hashes of the chunk's distinct words; the packed table is written once, and no
text moves after that.  Every chunk sends its distinct words and word pairs with
their training counts (0 where only held-out rows have them) to buckets by hash
range.  A bucket adds the counts up, tells each chunk the totals of its words, and
builds its segments of the filter: a pair of count c is entered under the levels
1 .. 1 + floor(log2 c).  A count is read back by probing level after level until
one is missing; the bucket probes for all pairs it was sent and tells each chunk
the levels of its own.  The smoothed probability

    P(w | v) = (c(v, w) + MU * P(w)) / (c(v) + MU),  P(w) = (c(w) + 1) / (N + V + 1)

takes its pair counts from such probes and its word counts from the levels of the
exact totals.  Segments are sized from their pairs, twice KEY_BITS a key, and cut by hash
range where one would pass its bound, so every training pair is held at any size.

Tokens: words between ASCII white space with A-Z lower-cased, then one end token.
Defined cases: a null or empty text is the end token alone; a null doc_id counts
as training; repeated rows count and score each on their own; with no training
rows N and V are 0.  Words are told apart by 64-bit XXH64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import LOWER, UPPER, written

CHUNK_BYTES = 8 << 20
BUCKET_ENTRIES = 2_000_000
#: Bound of one segment of the filter.
FILTER_BYTES = 64 << 20
KEY_BITS, PROBES, MU = 6, 4, 100.0
START, END = (np.uint64(xxhash.xxh64_intdigest(x, 42)) for x in (b" <s>", b" </s>"))  # no word holds a space
TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
CHUNKS = "chunk long, ids binary, nulls binary, held binary, sizes binary, tokens binary, words binary, entries long"
PARTS = "bucket int, chunk long, kind int, hashes binary, counts binary"
SUMS = "bucket int, chunk long, totals binary, tokens long, words long, levels binary"


def _zip(x: np.ndarray) -> bytes:
    """Compressed with equal-rank bytes side by side."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _unzip(raw: bytes, kind) -> np.ndarray:
    data = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, held, sizes, tokens, words, size = [], [], [], [], {}, 0

    def out():
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64)
        hashes = np.concatenate([[END], hashes])
        flat = np.concatenate(tokens)
        key = np.array([0 if i is None else i for i in ids], np.int64)
        row = (xxhash.xxh64_intdigest(key.tobytes() + hashes.tobytes() + np.random.bytes(8)) >> 1, key.tobytes(),
               np.array([i is None for i in ids]).tobytes(), np.array(held).tobytes(), np.array(sizes, np.int64).tobytes(),
               _zip(flat), _zip(hashes), len(hashes) + len(flat))
        kinds = [pa.int64()] + [pa.binary()] * 6 + [pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[x.split()[0] for x in CHUNKS.split(", ")])

    for batch in batches:
        for i, h, t in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("text")):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            own = raw.translate(TO_LOWER).split()
            number = words.setdefault
            tokens.append(np.array([number(w, len(words) + 1) for w in own] + [0], np.uint32))
            ids.append(i)
            held.append(bool(h))
            sizes.append(len(own) + 1)
            size += len(raw) + 16
            if size >= CHUNK_BYTES:
                yield out()
                ids, held, sizes, tokens, words, size = [], [], [], [], {}, 0
    if ids:
        yield out()


class Chunk:
    """A packed row, opened."""

    def __init__(self, row: dict):
        self.ids, self.nulls = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["nulls"], bool)
        self.held, self.sizes = np.frombuffer(row["held"], bool), np.frombuffer(row["sizes"], np.int64)
        self.tokens, self.words = _unzip(row["tokens"], np.uint32), _unzip(row["words"], np.uint64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.order = np.argsort(self.words, kind="stable")  # distinct words by hash

    def pairs(self) -> np.ndarray:
        h = self.words[self.tokens]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[self.first] = START
        return pair_hash(before, h)


def _parts(buckets: int):
    def cut(hashes, counts, chunk, kind):
        bucket = (hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        names, edge = np.unique(bucket, return_index=True)  # sorted hashes: a bucket is a slice
        for b, a, e in zip(names.tolist(), edge, [*edge[1:], len(hashes)]):
            yield b, chunk, kind, _zip(np.diff(hashes[a:e], prepend=np.uint64(0))), _zip(counts[a:e].astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row)
                train = np.repeat(~c.held, c.sizes)
                n = np.bincount(c.tokens[train], minlength=len(c.words))
                pairs, inverse = np.unique(c.pairs(), return_inverse=True)
                times = np.bincount(inverse[train], minlength=len(pairs))
                rows = [*cut(c.words[c.order], n[c.order], row["chunk"], 1), *cut(pairs, times, row["chunk"], 2)]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                                 names=[x.split()[0] for x in PARTS.split(", ")])
    return run


def places(hashes: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """The filter places of an n-gram at a level, inside its segment of ``bits`` bits."""
    x = mix(hashes ^ np.uint64(level * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
    step = mix(x) | np.uint64(1)
    for i in range(PROBES):
        yield (x + np.uint64(i) * step) % np.uint64(bits)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(float))[1].astype(np.int64)  # 1 + floor(log2 c); 0 for none


def build(hashes: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """One segment."""
    n = levels(counts)
    per_count, which = np.unique(counts, return_inverse=True)
    load = np.bincount(which, n)[::-1].cumsum()[::-1]  # keys of all n-grams of this count or more
    fits = per_count[load * KEY_BITS <= bits]
    keep = counts >= (fits[0] if len(fits) else np.iinfo(np.int64).max)
    hashes, n = hashes[keep], n[keep]
    segment = np.zeros(bits, bool)
    for level in range(1, int(n.max(initial=0)) + 1):
        for at in places(hashes[n >= level], level, bits):
            segment[at] = True
    return np.packbits(segment, bitorder="little").tobytes()


def expected(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, 0.75 * 2.0**level - 0.5, 0.0)  # the middle of 2^(l-1) .. 2^l - 1


class Filter:
    def __init__(self, data: bytes, buckets: int, bits: int):
        self.data, self.buckets, self.bits = np.frombuffer(data, np.uint8), buckets, bits

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """The highest level that is present with all below it."""
        base = ((hashes >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)) * np.uint64(self.bits)
        level, at = np.zeros(len(hashes), np.int64), np.arange(len(hashes))
        for n in range(1, 64):
            for i, place in enumerate(places(hashes[at], n, self.bits)):
                place = base[at] + place
                hit = self.data[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 > 0
                if i == 0:
                    alive = hit
                else:
                    alive &= hit
            at = at[alive]
            if not len(at):
                break
            level[at] = n
        return level

    def count(self, hashes: np.ndarray) -> np.ndarray:
        return expected(self.level(hashes))


def read_levels(hashes: np.ndarray, counts: np.ndarray, filter_bytes: int) -> np.ndarray:
    """Levels of sorted distinct ``hashes`` as read from a filter of all those with
    a count, in segments by hash range of at most ``filter_bytes`` bytes (or one key)."""
    load = np.cumsum(levels(counts)) * 2 * KEY_BITS
    out, a = np.zeros(len(hashes), np.uint8), 0
    while a < len(hashes):
        before = load[a - 1] if a else 0
        e = max(a + 1, int(np.searchsorted(load, before + filter_bytes * 8, side="right")))
        bits = max(64, -(-int(load[e - 1] - before) // 8) * 8)
        seen = counts[a:e] > 0
        out[a:e] = Filter(build(hashes[a:e][seen], counts[a:e][seen], bits), 1, bits).level(hashes[a:e])
        a = e
    return out


def _sum(filter_bytes: int):
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for kind in (1, 2):
            own = df[df["kind"] == kind]
            if own.empty:
                continue
            hashes = [np.cumsum(_unzip(x, np.uint64), dtype=np.uint64) for x in own["hashes"]]
            counts = np.concatenate([_unzip(x, np.uint32) for x in own["counts"]])
            sizes = [len(x) for x in hashes]
            distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(inverse, counts).astype(np.int64)
            back = total if kind == 1 else read_levels(distinct, total, filter_bytes)
            parts = zip(own["chunk"], np.split(back[inverse], np.cumsum(sizes)[:-1]))
            if kind == 1:
                rows += [(key[0], chunk, _zip(x), None, None, None) for chunk, x in parts]
                rows.append((key[0], None, None, int(total.sum()), int((total > 0).sum()), None))
            else:
                rows += [(key[0], chunk, None, None, None, _zip(x)) for chunk, x in parts]
        out = pd.DataFrame(rows, columns=[x.split()[0] for x in SUMS.split(", ")], dtype=object)
        return out.astype({"chunk": "Int64", "tokens": "Int64", "words": "Int64"})
    return run


def _score(tokens: int, words: int):
    def run(key: tuple, chunk: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(chunk.iloc[0].to_dict())
        count = np.empty(len(c.words), np.int64)
        sums = sums.sort_values("bucket")
        count[c.order] = np.concatenate([_unzip(x, np.int64) for x in sums["totals"].dropna()])
        base = np.log10((count + 1.0) / (tokens + words + 1.0))
        of_word = expected(levels(count))
        p_word = (of_word + 1.0) / (tokens + words + 1.0)
        inverse = np.unique(c.pairs(), return_inverse=True)[1]
        of_pair = expected(np.concatenate([_unzip(x, np.uint8) for x in sums["levels"].dropna()]).astype(np.int64))[inverse]
        before = np.empty(len(c.tokens))
        before[1:] = of_word[c.tokens[:-1]]
        before[c.first] = of_word[0]  # as many starts as ends
        p = (np.minimum(of_pair, np.maximum(before, of_pair)) + MU * p_word[c.tokens]) / (np.maximum(before, of_pair) + MU)
        add = lambda x: np.add.reduceat(x, c.first)
        ids = pd.array(c.ids, "Int64")
        ids[c.nulls] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": c.held, "n_tokens": c.sizes, "n_known": add((count > 0)[c.tokens].astype(np.int64)),
                             "train_tokens": tokens, "base_score": add(base[c.tokens]), "score": add(np.log10(p))})
    return run


def score_documents(docs: DataFrame, held_out: Column, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of
    every row; rows where ``held_out`` does not hold train the model."""
    spark = docs.sparkSession
    chunks = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
                                 F.col("text").cast("string").alias("text")).mapInArrow(_pack, CHUNKS), "lm-chunks")
    entries = chunks.agg(F.sum("entries")).first()[0] or 1  # words and pairs, a bound of the distinct ones
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-entries // BUCKET_ENTRIES))
    sums = (chunks.mapInArrow(_parts(buckets), PARTS).repartition(buckets, "bucket").groupBy("bucket")
            .applyInPandas(_sum(filter_bytes), SUMS))
    sums = written(sums, "lm-sums")
    tokens, words = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    left = chunks.repartition(parts, "chunk").groupBy("chunk")
    right = (sums.where("chunk is not null").select("chunk", "bucket", "totals", "levels").repartition(parts, "chunk")
             .groupBy("chunk"))
    return left.cogroup(right).applyInPandas(_score(tokens, words),
                                             "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

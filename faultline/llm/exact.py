"""Exact dedup over a cuckoo-filter index of live digests.

Texts are equal when identical after white space is deleted; a text stands for
itself by the SHA-256 of what is left.  The index deals digests to shards of a
bounded number of keys.  A shard is a cuckoo filter (16-bit fingerprints, four to a
bucket, each in one of two buckets) with, beside every slot, the stored key that
the fingerprint stands for:

* a digest whose fingerprint is in neither bucket is new, with nothing to compare;
* a hit is verified against the full keys stored in those buckets, so that a false
  hit costs a comparison and never a document;
* a key is put in by moving others to their second bucket; when that chain gets too
  long the shard doubles its buckets and is filled again from its stored keys;
* a digest that no live document has any more leaves its slot.

The index is an ordinary table, a row per live digest with its place in the filter,
so a later batch loads the filters without any insertion.  Documents are combined
per Arrow batch before they are shuffled: a text that a third of all rows share sends
one row a batch.  What a shard does with its rows (sums, least of a total order)
does not depend on their order, so a rerun after a lost executor gives the same.

Defined cases: a null text counts as empty.  Of equal texts the row with the most
code points stays, then the smallest id (a null id comes last), then the row read
first: of repeated rows exactly one stays.  An empty table gives an empty index.
Very long texts are digested where they are read and never shuffled.  Further
columns, whatever their names, are returned as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import BROADCAST_BYTES, fresh, written
from faultline.session import ship_package

SLOTS = 4
MAX_KICKS = 200
SHARD_KEYS = 1 << 17
SPACE = " \t\n\x0b\x0c\r"
STORED, ADD, SET = 0, 1, 2  # kinds of rows that reach a shard, in this order
ENTRY = "shard int, kind int, buckets int, slot int, key binary, n long, size long, null_id long, id long, rid long"
NUMBERS = ("n", "size", "null_id", "id", "rid")
NO_ID = np.iinfo(np.int64).max


class Shard:
    """The live digests of one shard; keys are rows of four 64-bit numbers."""

    def __init__(self, buckets: int = 64, max_kicks: int = MAX_KICKS):
        self.max_kicks = max_kicks
        self.keys = np.zeros((0, 4), np.uint64)
        self.vals = np.zeros((0, len(NUMBERS)), np.int64)
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.buckets = buckets
        self.marks = np.zeros((buckets, SLOTS), np.uint16)  # 0: free
        self.refs = np.full((buckets, SLOTS), -1, np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and the two buckets; each bucket follows from the other."""
        mark = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        a = (keys[:, 0] & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, a, a ^ self._hop(mark)

    def _hop(self, mark):
        return (np.asarray(mark, np.int64) * 0x5BD1E995 >> 7) & (self.buckets - 1)

    def load(self, slots: np.ndarray, keys: np.ndarray, vals: np.ndarray, buckets: int) -> None:
        """Stored keys go back to the places they had."""
        if not len(self.keys):
            self._empty(buckets)
        at = np.arange(len(self.keys), len(self.keys) + len(keys))
        self.keys, self.vals = np.concatenate([self.keys, keys]), np.concatenate([self.vals, vals])
        self.marks.reshape(-1)[slots], self.refs.reshape(-1)[slots] = self._places(keys)[0], at

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the stored key equal to each key, or -1, and its slot."""
        mark, a, b = self._places(keys)
        got, slot = np.full(len(keys), -1, np.int64), np.full(len(keys), -1, np.int64)
        for bucket in (a, b):
            for s in range(SLOTS):
                rows = np.flatnonzero((self.marks[bucket, s] == mark) & (got < 0))
                if len(rows):
                    ref = self.refs[bucket[rows], s]
                    same = (self.keys[ref] == keys[rows]).all(axis=1)  # the filter may err, stored content does not
                    got[rows[same]], slot[rows[same]] = ref[same], bucket[rows[same]] * SLOTS + s
        return got, slot

    def _insert(self, mark: int, bucket: int, ref: int) -> bool:
        for kick in range(self.max_kicks):
            for at in (bucket, bucket ^ int(self._hop(mark))) if kick == 0 else (bucket,):
                free = np.flatnonzero(self.marks[at] == 0)
                if len(free):
                    self.marks[at, free[0]], self.refs[at, free[0]] = mark, ref
                    return True
            s = (mark + kick) % SLOTS
            out = int(self.marks[bucket, s]), int(self.refs[bucket, s])
            self.marks[bucket, s], self.refs[bucket, s] = mark, ref
            mark, ref = out
            bucket ^= int(self._hop(mark))
        return False

    def put(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Insert keys that are not in the index."""
        first = len(self.keys)
        self.keys, self.vals = np.concatenate([self.keys, keys]), np.concatenate([self.vals, vals])
        mark, a, _ = self._places(keys)
        for i, (m, at) in enumerate(zip(mark.tolist(), a.tolist())):
            if not self._insert(m, at, first + i):
                return self._grow()

    def _grow(self) -> None:
        """Twice the buckets, as often as it takes, filled from all stored keys."""
        while True:
            self._empty(self.buckets * 2)
            mark, a, _ = self._places(self.keys)
            live = np.flatnonzero(self.vals[:, 0] > 0).tolist()
            if all(self._insert(int(mark[i]), int(a[i]), i) for i in live):
                return

    def add(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """Distinct keys with counts and best rows, merged into what is stored."""
        got, _ = self.find(keys)
        old, rows = got[got >= 0], np.flatnonzero(got >= 0)
        if len(old):
            mine, new = self.vals[old], vals[rows]
            best = np.where(_before(new, mine)[:, None], new, mine)
            best[:, 0] = mine[:, 0] + new[:, 0]
            self.vals[old] = best
        if (got < 0).any():
            self.put(keys[got < 0], vals[got < 0])

    def replace(self, keys: np.ndarray, vals: np.ndarray) -> None:
        """New counts and best rows of stored keys; a count of 0 deletes."""
        got, slot = self.find(keys)
        self.vals[got[got >= 0]] = vals[got >= 0]
        gone = slot[(got >= 0) & (vals[:, 0] <= 0)]
        self.marks.reshape(-1)[gone], self.refs.reshape(-1)[gone] = 0, -1

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slots = np.flatnonzero(self.marks.reshape(-1))
        at = self.refs.reshape(-1)[slots]
        return slots, self.keys[at], self.vals[at]


def _before(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether row x stays rather than row y: size down, null ids last, id, rid."""
    out = np.zeros(len(x), bool)
    tied = np.ones(len(x), bool)
    for c, sign in ((1, -1), (2, 1), (3, 1), (4, 1)):
        a, b = sign * x[:, c], sign * y[:, c]
        out |= tied & (a < b)
        tied &= a == b
    return out


def _combine(keys: np.ndarray, vals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row for each distinct key: counts summed, the best row of all."""
    order = np.lexsort((vals[:, 4], vals[:, 3], vals[:, 2], -vals[:, 1], *keys.T))
    keys, vals = keys[order], vals[order]
    start = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
    best = vals[start]
    best[:, 0] = np.add.reduceat(vals[:, 0], start)
    return keys[start], best


def _keys(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def _ints(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _batch(shard, kind: int, buckets: int, slots, keys, vals) -> pa.RecordBatch:
    m = len(keys)
    whole = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int32), m).copy())
    raw = np.ascontiguousarray(keys).tobytes()
    cols = [whole(shard), whole(kind), whole(buckets), whole(slots), pa.array([raw[i: i + 32] for i in range(0, 32 * m, 32)], pa.binary())]
    return pa.RecordBatch.from_arrays([*cols, *(pa.array(vals[:, j]) for j in range(len(NUMBERS)))], names=[x.split()[0] for x in ENTRY.split(", ")])


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a batch that share a digest become one before the shuffle."""
    for batch in batches:
        if batch.num_rows:
            keys, vals = _combine(_keys(batch.column("key")), np.stack([_ints(batch, c) for c in NUMBERS], axis=1))
            yield _batch(0, ADD, 0, 0, keys, vals)


def _settle(buckets: int, max_kicks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by shard and kind pass through that shard's filter."""
        now, shard = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            home, kind, keys = _ints(batch, "shard"), _ints(batch, "kind"), _keys(batch.column("key"))
            vals = np.stack([_ints(batch, c) for c in NUMBERS], axis=1)
            cuts = np.flatnonzero((home[1:] != home[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(home)]):
                if home[a] != now:
                    if shard is not None:
                        yield _batch(now, STORED, shard.buckets, *_live(shard))
                    now, shard = int(home[a]), Shard(buckets, max_kicks)
                if kind[a] == STORED:
                    shard.load(_ints(batch, "slot")[a:b], keys[a:b], vals[a:b], int(_ints(batch, "buckets")[a]))
                elif kind[a] == ADD:
                    shard.add(*_combine(keys[a:b], vals[a:b]))
                else:
                    shard.replace(keys[a:b], vals[a:b])
        if shard is not None:
            yield _batch(now, STORED, shard.buckets, *_live(shard))
    return run


def _live(shard: Shard):
    slots, keys, vals = shard.rows()
    return slots, keys, vals


@dataclass
class ExactIndex:
    """Live documents (the columns asked for, digest, size and row number) and the
    shards' tables, a row per live digest with its slot."""

    members: DataFrame
    entries: DataFrame
    shards: int
    names: dict
    rounds: int = 1


def digest(text: Column) -> Column:
    """SHA-256 of a text without its white space, as bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACE, ""), 256))


def _members(docs: DataFrame, columns: list[str], id_col: str, text_col: str, base: int) -> tuple[DataFrame, dict]:
    names = dict(zip(("key", "size", "rid", "id"), fresh(docs, "_digest", "_size", "_row", "_id")))
    size = F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long")
    out = docs.select(*[F.col(f"`{c}`") for c in columns], digest(F.col(text_col)).alias(names["key"]), size.alias(names["size"]),
                      (F.monotonically_increasing_id() + F.lit(base)).alias(names["rid"]), F.col(id_col).cast("long").alias(names["id"]))
    return written(out, "exact-members"), names


def _rows(members: DataFrame, names: dict) -> DataFrame:
    i = F.col(names["id"])
    return members.select(F.lit(0).alias("shard"), F.lit(ADD).alias("kind"), F.lit(0).alias("buckets"), F.lit(0).alias("slot"),
                          F.col(names["key"]).alias("key"), F.lit(1).cast("long").alias("n"), F.col(names["size"]).alias("size"),
                          i.isNull().cast("int").cast("long").alias("null_id"), F.coalesce(i, F.lit(int(NO_ID))).alias("id"), F.col(names["rid"]).alias("rid"))


def _advance(entries: DataFrame, shards: int, buckets: int, max_kicks: int) -> DataFrame:
    """Stored and new rows brought together by shard, a bounded number of shards
    to a task, and run through the filters."""
    spark = entries.sparkSession
    tasks = min(shards, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = (entries.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
             .repartition(tasks, "shard").sortWithinPartitions("shard", "kind"))
    return written(dealt.mapInArrow(_settle(buckets, max_kicks), ENTRY), "exact-entries")


def build(docs: DataFrame, columns: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text",
          shard_keys: int = SHARD_KEYS, buckets: int = 64, max_kicks: int = MAX_KICKS) -> ExactIndex:
    """The index of all documents."""
    ship_package(docs.sparkSession)
    members, names = _members(docs, columns or docs.columns, id_col, text_col, 0)
    shards = max(1, -(-members.count() // shard_keys))
    entries = _advance(_rows(members, names).mapInArrow(_combined, ENTRY), shards, buckets, max_kicks)
    return ExactIndex(members, entries, shards, names)


def insert(index: ExactIndex, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           buckets: int = 64, max_kicks: int = MAX_KICKS) -> ExactIndex:
    """More documents (with the columns the index keeps); those already in stay first among equals."""
    own = index.members.columns[:-4]
    members, names = _members(docs.select(*[f"`{c}`" for c in dict.fromkeys([*own, id_col, text_col])]), own, id_col, text_col, index.rounds << 56)
    for k, v in names.items():
        members = members.withColumnRenamed(v, index.names[k])
    new = _rows(members, index.names).mapInArrow(_combined, ENTRY)
    entries = _advance(index.entries.unionByName(new), index.shards, buckets, max_kicks)
    return ExactIndex(index.members.unionByName(members), entries, index.shards, index.names, index.rounds + 1)


def delete(index: ExactIndex, ids: DataFrame, max_kicks: int = MAX_KICKS) -> ExactIndex:
    """Documents whose id is in ``ids`` (one column) go.  Digests they had get the
    counts and the best row of what is left, or leave the filter."""
    k = index.names
    ids = ids.select(F.col(ids.columns[0]).cast("long").alias(k["id"])).distinct()
    gone = index.members.join(ids, k["id"], "left_semi").select(k["key"]).distinct()
    members = written(index.members.join(ids, k["id"], "left_anti").select(*index.members.columns), "exact-members")
    rest = _rows(members.join(gone, k["key"], "left_semi"), k)
    order = F.struct(-F.col("size"), "null_id", "id", "rid")
    best = rest.groupBy("key").agg(F.sum("n").alias("n"), *[F.min_by(c, order).alias(c) for c in NUMBERS[1:]])
    new = gone.withColumnRenamed(k["key"], "key").join(best, "key", "left").select(
        F.lit(0).alias("shard"), F.lit(SET).alias("kind"), F.lit(0).alias("buckets"), F.lit(0).alias("slot"), "key",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in NUMBERS])
    return ExactIndex(members, _advance(index.entries.unionByName(new), index.shards, 64, max_kicks), index.shards, k, index.rounds)


def decisions(index: ExactIndex) -> DataFrame:
    """Every live document with ``_exact``: keep_id, group_size, kept, text_sha256.

    Only texts that several documents share are joined; those that over a
    thousandth of all rows share are fewer than a thousand and broadcast, so that
    no shuffle partition holds a hot text."""
    k, spark = index.names, index.members.sparkSession
    many = index.entries.where("n > 1").select(F.col("key").alias("g_key"), F.col("n").alias("g_n"), F.col("rid").alias("g_rid"),
                                               F.when(F.col("null_id") == 0, F.col("id")).alias("g_id"))
    live = index.members
    total, groups = (index.entries.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 1, 1))).first())
    cols = [F.col(f"`{c}`") for c in live.columns[:-4]]
    exact = fresh(live, "_exact")[0]

    def with_(side: DataFrame, rows: DataFrame) -> DataFrame:
        alone = F.col("g_n").isNull()
        out = F.struct(F.when(alone, F.col(k["id"])).otherwise(F.col("g_id")).alias("keep_id"), F.coalesce("g_n", F.lit(1)).cast("long").alias("group_size"),
                       (alone | (F.col("g_rid") == F.col(k["rid"]))).alias("kept"), F.lower(F.hex(k["key"])).alias("text_sha256"))
        return rows.join(side, rows[k["key"]] == side["g_key"], "left").select(*cols, out.alias(exact))

    if groups * 96 <= BROADCAST_BYTES:
        return with_(F.broadcast(many), live)
    hot = many.where(F.col("g_n") * 1000 > total)
    few = F.broadcast(hot.select(F.col("g_key").alias(k["key"])))
    return with_(F.broadcast(hot), live.join(few, k["key"], "left_semi")).unionByName(
        with_(many.where(F.col("g_n") * 1000 <= total), live.join(few, k["key"], "left_anti")))


def exact_dedup(docs: DataFrame, columns: list[str] | None = None, **options) -> DataFrame:
    """All documents with the column ``_exact`` (longer where taken) by :func:`decisions`."""
    return decisions(build(docs, columns, **options))

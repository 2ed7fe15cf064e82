"""Line de-duplication by a segment-partition edit join.

Lines of at least ``min_chars`` characters take part; with ``short`` also shorter
ones that are not blank, each in a class of its exact text.  A line is cut into
tau + 1 segments of even length; of two lines within tau edits at least one
segment of the shorter survives in the longer, at a place that the lengths and the
segment's number bound (multi-match-aware windows).  Segments (index) and the
longer line's substrings of those places (probes) meet by a hash of segment text,
number and line length.  Lines that meet are verified by banded bit-parallel edit
distance, all pairs of a batch at once.

A verified probe names the smallest index line it matched and hangs its other
matches on it, so that a group of many variants gives one row per member and hub
and not all pairs.  Keys with very many entries are dealt over a grid of sub-keys.

Lines within tau edits, directly or through others, form a class; its first
occurrence (smallest doc_id, then line number) stays, the rest go.

Defined cases: null text counts as no lines and stays null; a null doc_id sorts
after every other id; rows that share doc_id and text are one document and get
equal results; rows of one doc_id with other texts keep their own first line each.
Lines are identified by their 64-bit XXH64.  Other columns are carried untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import BROADCAST_BYTES, broadcast_checked, fresh, written
from faultline.llm.graph import connected_components

TAU = 2
MIN_CHARS = 20
CHUNK_CHARS = 1 << 21
#: Members of a key beyond which the key is dealt over a grid.
BLOCK = 1024
LAST = (1 << 63) - 1
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def segments(length: np.ndarray, tau: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of each of the tau + 1 even segments."""
    size, longer = length // (tau + 1), length % (tau + 1)
    out, at = [], np.zeros_like(length)
    for i in range(tau + 1):
        n = size + (i >= tau + 1 - longer)
        out.append((at, n))
        at = at + n
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(lines: list[str], tau: int, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(line number, key) of all index entries (even keys) and probes (odd keys)."""
    code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.array([len(x) for x in lines], np.int64)
    begin = np.cumsum(length) - length
    power = np.cumprod(np.full(len(code) + 1, BASE)) * INVERSE
    back = np.cumprod(np.full(len(code) + 1, INVERSE)) * BASE
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(code + np.uint64(1)) * power[:-1])])
    at, out = np.arange(len(lines)), []

    def add(rows, start, size, number, short, role):
        a = begin[rows] + start
        h = (total[a + size] - total[a]) * back[a]
        h = _mix(h ^ _mix(short.astype(np.uint64) * BASE + np.uint64(number)))
        out.append((rows, h & ~np.uint64(1) | np.uint64(role)))

    for i, (start, size) in enumerate(segments(length, tau)):
        add(at, start, size, i, length, 0)
    for more in range(tau + 1):  # the probing line is this much longer
        rows = at[length - more >= min_chars]
        short = length[rows] - more
        for i, (start, size) in enumerate(segments(short, tau)):
            for shift in range(max(-i, more - (tau - i)), min(i, more + tau - i) + 1):
                ok = (start + shift >= 0) & (start + shift + size <= length[rows])
                add(rows[ok], (start + shift)[ok], size[ok], i, short[ok], 1)
    return np.concatenate([r for r, _ in out]), np.concatenate([k for _, k in out])


def _keys(tau: int, min_chars: int):
    def emit(lines: dict[str, None]) -> pa.RecordBatch:
        texts = list(lines)
        ids = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in texts], np.uint64)
        row, key = keys(texts, tau, min_chars)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row].view(np.int64))], names=["key", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, chars = {}, 0
        for batch in batches:
            for text in batch.column("text"):
                for line in (text.as_py() or "").split("\n"):
                    if len(line) >= min_chars and line not in lines:
                        lines[line] = None
                        chars += len(line)
                        if chars >= CHUNK_CHARS:
                            yield emit(lines)
                            lines, chars = {}, 0
        if lines:
            yield emit(lines)
    return run


def _runs(group: np.ndarray) -> np.ndarray:
    """First row of every run of equal values, and the end."""
    return np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]]) if len(group) else np.zeros(1, int)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by key and id: the rows of keys under which different
    lines meet, without repeats.  An open run is held up to a bound; a longer
    run is passed on as it comes."""
    def out(key, ids):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids)], names=["key", "id"])

    held_key, held_id, passing = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        key = np.concatenate([held_key, batch.column("key").to_numpy()])
        ids = np.concatenate([held_id, batch.column("id").to_numpy()])
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
        key, ids = key[new], ids[new]
        cut = _runs(key >> 1)
        keep = np.zeros(len(key), bool)
        first, size = cut[:-1], np.diff(cut)
        probes = np.add.reduceat(key & 1, first)
        distinct = np.maximum.reduceat(ids, first) != np.minimum.reduceat(ids, first)
        good = (probes > 0) & (probes < size) & distinct
        good |= (key[first] >> 1) == passing if passing is not None else False
        keep = np.repeat(good, size)
        tail = cut[-2]  # the last run may go on in the next batch
        if len(key) - tail > 65536 or keep[tail]:
            keep[tail:], passing = True, key[tail] >> 1
            held_key, held_id = key[:0], ids[:0]
        else:
            keep[tail:], passing = False, None
            held_key, held_id = key[tail:], ids[tail:]
        if keep.any():
            yield out(key[keep], ids[keep])


def within(a: np.ndarray, b: np.ndarray, codes: np.ndarray, begin: np.ndarray, length: np.ndarray, tau: int) -> np.ndarray:
    """Whether lines a[i] and b[i] are within ``tau`` edits, by the banded
    bit-parallel recurrence over all pairs at once.

    Bit k of the vectors stands for pattern row j - tau + k in column j; rows
    outside the pattern never match.  The lowest diagonal's distance is carried
    and, in the last column, walked up to the pattern's last row.
    """
    n_a, n_b = length[a], length[b]
    result = np.zeros(len(a), bool)
    order = np.argsort(-n_b, kind="stable")
    order = order[np.abs(n_a - n_b)[order] <= tau]
    one, mask = np.uint64(1), np.uint64((1 << (2 * tau + 1)) - 1)
    bottom = np.uint64(2 * tau)
    vp = np.full(len(order), ((1 << (tau + 1)) - 1) << tau, np.uint64)
    vn = np.zeros(len(order), np.uint64)
    score = np.full(len(order), tau, np.int64)
    ba, bb, la, lb = begin[a[order]], begin[b[order]], n_a[order], n_b[order]
    for j in range(1, int(lb.max(initial=0)) + 1):
        live = int(np.searchsorted(-lb, -j, side="right"))  # lengths fall
        if not live:
            break
        if live < len(lb):
            vp, vn, score, order = vp[:live], vn[:live], score[:live], order[:live]
            ba, bb, la, lb = ba[:live], bb[:live], la[:live], lb[:live]
        t = codes[bb + j - 1]
        m = np.zeros(live, np.uint64)
        for k in range(2 * tau + 1):
            row = j - tau + k - 1  # zero-based place in the pattern
            if row >= 0:
                m |= ((row < la) & (codes[np.minimum(ba + row, len(codes) - 1)] == t)).astype(np.uint64) << np.uint64(k)
        d0 = ((((m & vp) + vp) ^ vp) | m | vn) & mask
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        score += 1 - (d0 >> bottom & one).astype(np.int64)
        down = d0 >> one
        vp = (hn | ~(down | hp)) & mask
        vn = down & hp
        done = lb == j
        if done.any():
            total = score[done].copy()
            delta = la[done] - j
            for k in range(2 * tau):
                step = (vp[done] >> np.uint64(k) & one).astype(np.int64) - (vn[done] >> np.uint64(k) & one).astype(np.int64)
                total -= np.where(k >= delta + tau, step, 0)
            result[order[done]] = total <= tau
        if j % 16 == 0:
            ok = score <= 3 * tau
            if not ok.all():
                vp, vn, score, order, ba, bb, la, lb = (x[ok] for x in (vp, vn, score, order, ba, bb, la, lb))
    result[(n_a == 0) & (n_b <= tau) | (n_b == 0) & (n_a <= tau)] = True
    return result


def _verify(tau: int):
    def edges(ids, codes, begin, length, i, p):
        """Hub edges of candidate pairs (index row, probe row), grouped by probe."""
        ok = ids[i] != ids[p]
        i, p = i[ok], p[ok]
        ok = within(i, p, codes, begin, length, tau)
        i, p = i[ok], p[ok]
        if not len(i):
            return None
        cut = _runs(p)
        hub = np.repeat(np.minimum.reduceat(ids[i], cut[:-1]), np.diff(cut))
        e = np.concatenate([np.stack([hub, ids[i]], 1), np.stack([hub, ids[p]], 1)])
        e.sort(axis=1)
        return np.unique(e[e[:, 0] != e[:, 1]], axis=0)

    def work(key, ids, lines):
        """Rows of whole runs, sorted by key (index entries before probes)."""
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.array([len(x) for x in lines], np.int64)
        begin = np.cumsum(length) - length
        group = key >> 1
        index = np.flatnonzero(key & 1 == 0)
        probe = np.flatnonzero(key & 1)
        lo, hi = np.searchsorted(group[index], group[probe], "left"), np.searchsorted(group[index], group[probe], "right")
        size, weight = hi - lo, (hi - lo) * (length[probe] + 1)
        cut = np.concatenate([[0], np.cumsum(weight)])
        a = 0
        while a < len(probe):  # a bounded number of compared characters at a time
            b = max(a + 1, int(np.searchsorted(cut, cut[a] + CHUNK_CHARS, side="right")) - 1)
            n = size[a:b]
            p = np.repeat(probe[a:b], n)
            start = np.repeat(lo[a:b] - (np.cumsum(n) - n), n)
            i = index[start + np.arange(len(p))]
            e = edges(ids, codes, begin, length, i, p)
            if e is not None and len(e):
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["a", "b"])
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, lines = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            ids = np.concatenate([ids, batch.column("id").to_numpy()])
            lines += batch.column("line").to_pylist()
            end = int(np.searchsorted(key >> 1, key[-1] >> 1, "left"))  # the last run may go on
            if end:
                yield from work(key[:end], ids[:end], lines[:end])
                key, ids, lines = key[end:], ids[end:], lines[end:]
        if len(key):
            yield from work(key, ids, lines)
    return run


def _eligible(docs: DataFrame, min_chars: int, short: bool = False) -> DataFrame:
    """d, t (text hash), n (line number), line, id of every line that takes part."""
    some = F.char_length("line") >= min_chars
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d")
    return (docs.select(d, F.xxhash64("text").alias("t"), F.posexplode(F.split(F.col("text"), "\n")).alias("n", "line"))
            .where(some | F.col("line").rlike(r"\S") if short else some).withColumn("id", F.xxhash64("line")))


def line_links(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hub edges (a, b) between ids of distinct lines; they connect exactly the
    lines that chains of at most ``tau`` edits connect."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_keys(tau, min_chars), "key long, id long")
           .repartition(parts, F.shiftright("key", 1)).sortWithinPartitions(F.col("key"), F.col("id"))
           .mapInArrow(_meet, "key long, id long"))
    met = written(met, "lines-met")
    wanted = broadcast_checked(written(met.select("id").distinct(), "lines-wanted"), 24, limit)
    texts = _eligible(docs, min_chars).select("id", "line").join(wanted, "id").dropDuplicates(["id"])
    group = F.shiftright("key", 1)
    hot = written(met.groupBy(group.alias("group")).count().where(F.col("count") > BLOCK)
                  .select("group", F.ceil(F.col("count") / BLOCK).cast("int").alias("side")), "lines-hot")
    met = met.withColumn("group", group)
    if not hot.isEmpty():  # index blocks x probe blocks
        mine, every = F.pmod(F.xxhash64("id"), F.col("side")).cast("int"), F.sequence(F.lit(0), F.col("side") - 1)
        index = F.col("key") % 2 == 0
        grid = F.transform(every, lambda x: F.struct(F.when(index, mine).otherwise(x).alias("i"), F.when(index, x).otherwise(mine).alias("p")))
        cell = F.explode(F.when(F.col("side").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("p")))).otherwise(grid)).alias("cell")
        met = met.join(broadcast_checked(hot, 16, limit), "group", "left").select("key", "id", "side", "group", cell)
        sub = F.xxhash64("group", "cell.i", "cell.p")
        met = met.withColumn("key", F.when(F.col("side").isNull(), F.col("key")).otherwise(
            F.shiftleft(sub, 1).bitwiseOR(F.col("key").bitwiseAND(1)))).withColumn("group", F.shiftright("key", 1))
    return (met.join(texts, "id").repartition(parts, "group").sortWithinPartitions("key")
            .select("key", "id", "line").mapInArrow(_verify(tau), "a long, b long").distinct())


def removed_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, limit: int = BROADCAST_BYTES, short: bool = False) -> DataFrame:
    """d, t, gone (numbers of the lines to remove) of the documents that lose lines."""
    tree = written(connected_components(line_links(docs, tau, min_chars, limit)), "lines-tree")
    occ = _eligible(docs, min_chars, short).select("d", "t", "n", "id")
    occ = occ.join(broadcast_checked(tree, 32, limit).withColumnRenamed("node", "id"), "id", "left")
    occ = written(occ.select("d", "t", "n", F.coalesce("root", "id").alias("cls")), "lines-occ")
    # one row per document, class: its lines; a class's first document keeps its first line
    mine = occ.groupBy("cls", "d", "t").agg(F.min("n").alias("lo"), F.collect_set("n").alias("ns"))
    first = occ.groupBy("cls").agg(F.min("d").alias("first"), F.count("*").alias("c")).where("c > 1").select("cls", "first")
    first = broadcast_checked(written(first, "lines-first"), 32, limit)
    gone = mine.join(first, "cls").withColumn("gone", F.when(F.col("d") == F.col("first"), F.array_except("ns", F.array("lo"))).otherwise(F.col("ns")))
    return gone.where(F.size("gone") > 0).groupBy("d", "t").agg(F.flatten(F.collect_list("gone")).alias("gone"))


def dedup_lines(docs: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, limit: int = BROADCAST_BYTES, short: bool = False) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text`` and ``_lines``: n_lines
    and n_removed (an input column of that name is replaced)."""
    gone = written(removed_lines(docs, tau, min_chars, limit, short), "lines-gone")
    volume = gone.agg(F.sum(F.lit(64) + 8 * F.size("gone"))).first()[0] or 0
    gone = (F.broadcast(gone) if volume <= limit else gone).alias("g")
    d, t = fresh(docs, "_d", "_t")
    base = docs.withColumn(d, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))).withColumn(t, F.xxhash64("text")).alias("b")
    out = base.join(gone, (F.col(f"b.{d}") == F.col("g.d")) & (F.col(f"b.{t}") == F.col("g.t")), "left")
    lines = F.split(F.col("b.text"), "\n")
    keep = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("g.gone")))
    text = F.when(F.col("g.gone").isNull(), F.col("b.text")).otherwise(F.array_join(F.transform(keep, lambda i: F.get(lines, i)), "\n"))
    stats = F.struct(F.when(F.col("b.text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"), F.coalesce(F.size("g.gone"), F.lit(0)).alias("n_removed"))
    return out.select(*[text.alias("text") if c == "text" else F.col(f"b.`{c}`") for c in docs.columns if c.lower() != "_lines"], stats.alias("_lines"))

"""Hard-negative mining by slot-decomposed selection.

An anchor's positives are its best rows of the same label.  Each positive asks for
the best rows of other labels whose score lies in its window, from ``low`` to
``high`` times the positive's score.  The windows of one anchor overlap, so they are
not searched one by one: the positives' upper limits, in descending order, cut the
scores into disjoint slots.  Slot j holds the scores above upper limit j+1 up to
upper limit j.  One pass over the candidates keeps the k best of every slot; combiners
merge the slots' lists up a tree; then, from the lowest slot upwards, each slot's
list is merged with that of the slots below it.  What has gathered at slot j is the
k best of all scores up to upper limit j, and the part of it at or above a
positive's lower limit answers that positive's window exactly.

Both passes (positives, then slots) run on a grid: anchors are packed to tiles,
candidates to shards, and a (tile, shard) cell is one bounded matrix product that
keeps a bounded number of rows per anchor.  No row is keyed by its label, so a label
that a third of all rows carry makes no task larger.

Defined cases: a row with a null id, label or vector, or with a null or non-finite
component, takes no part.  Vectors meet vectors of their own length only.  Repeated
rows count each on their own, but an anchor never meets rows of its own id.  Ties go
to the smaller id.  A positive whose window is empty (its score is negative, or no
row lies in it) gives no row, nor does an anchor without positives; an empty table
gives an empty result.  Scores are exact while they fit a double's 53 bits; a larger
one is computed with Python integers and held to the range of a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import written
from faultline.session import ship_package

PACK = "dim int, home long, n int, ids binary, labels binary, data binary, kind string"
TILE = "t int, dim int, ids binary, labels binary, data binary, limits binary, rows binary, pids binary, scores binary"
LISTS = "t int, dim int, g int, rows binary, slots binary, ids binary, scores binary"
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
LONG = np.iinfo(np.int64)
KINDS = (("int16", 2.0**15), ("int32", 2.0**31))


def _pack(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids, labels = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label"))
            lists = batch.column("vec")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.floor(256.0 * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            ends = np.cumsum(sizes)
            out = []
            for dim in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == dim)
                values = flat[(ends[rows] - dim)[:, None] + np.arange(dim)]
                good = np.isfinite(values).all(axis=1)
                rows, values = rows[good], values[good]
                for a in range(0, len(rows), block_rows):
                    part, who = values[a: a + block_rows], rows[a: a + block_rows]
                    most = np.abs(part).max(initial=0)
                    kind = next((k for k, bound in KINDS if most < bound), "float64")
                    raw, key = part.astype(kind).tobytes(), ids[who].tobytes()
                    out.append((dim, xxhash.xxh64_intdigest(key + raw, 11) >> 1, len(who), key, labels[who].tobytes(), raw, kind))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("dim", "home", "n", "ids", "labels", "data", "kind"), r)) for r in out],
                                                 schema=pa.schema([("dim", pa.int32()), ("home", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()),
                                                                   ("labels", pa.binary()), ("data", pa.binary()), ("kind", pa.string())]))
    return run


def _blocks(df: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and values of blocks, in an order set by their content."""
    for r in df.sort_values(["home", "n"], kind="stable").itertuples():
        yield (np.frombuffer(r.ids, np.int64), np.frombuffer(r.labels, np.int64),
               np.frombuffer(r.data, r.kind).astype(np.float64).reshape(r.n, r.dim))


def scores_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers."""
    reach = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if reach < 2.0**53:
        return (a @ b.T).astype(np.int64)
    rows, cols = ([list(map(int, r)) for r in m] for m in (a, b))
    return np.array([[min(max(sum(map(int.__mul__, x, y)), LONG.min), LONG.max) for y in cols] for x in rows], np.int64).reshape(len(a), len(b))


def select(group: list[np.ndarray], ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best rows (highest score, then smallest id) of each group, ordered."""
    order = np.lexsort((ids, ~scores, *group[::-1]))
    if not len(order):
        return order
    new = np.concatenate([[True], np.any([g[order][1:] != g[order][:-1] for g in group], axis=0)])
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(new, at, 0)) < k]


def _best_columns(s: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that may be among the k best of their row, ties included."""
    if s.shape[1] > k:
        held = np.where(ok, s, LONG.min)
        ok = ok & (held >= np.partition(held, s.shape[1] - k, axis=1)[:, [s.shape[1] - k]])
    return np.nonzero(ok)


def _lists(t, dim, g, rows, slots, ids, scores) -> pd.DataFrame:
    return pd.DataFrame([(t, dim, g, *(x.astype(np.int64).tobytes() for x in (rows, slots, ids, scores)))], columns=[c.split()[0] for c in LISTS.split(", ")])


def _cell(k: int, anchors_of, candidates_of):
    """One (tile, shard) cell: ``candidates_of`` names, for a block, the rows that
    may count and each one's slot; k of every (anchor, slot) stay."""
    def run(key: tuple, tile: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        t, g, dim = key
        kept = [np.zeros(0, np.int64)] * 4
        if len(tile) and len(shard):
            ids, labels, values, limits = anchors_of(tile)
            for cids, clabels, cvalues in _blocks(shard):
                s = scores_of(values, cvalues)
                new = candidates_of(s, labels[:, None] == clabels[None, :], ids[:, None] == cids[None, :], limits, k)
                rows, slots, cols = new
                all_ = [np.concatenate(x) for x in zip(kept, (rows, slots, cids[cols], s[rows, cols]))]
                at = select(all_[:2], all_[2], all_[3], k)
                kept = [x[at] for x in all_]
        return _lists(t, dim, g, *kept)
    return run


def _same_label(s, same, own, limits, k):
    rows, cols = _best_columns(s, same & ~own, k)
    return rows, np.zeros_like(rows), cols


def _by_slot(s, same, own, limits, k):
    """Slot of a score: how many upper limits are below it, from the highest down."""
    n_slots = limits.shape[1]
    slot = (s[:, :, None] <= limits[:, None, :]).sum(axis=2) - 1  # limits descend; -1 is above all
    found = [_best_columns(s, (slot == j) & ~same & ~own, k) for j in range(n_slots)]
    return (np.concatenate([r for r, _ in found]), np.concatenate([np.full(len(r), j) for j, (r, _) in enumerate(found)]),
            np.concatenate([c for _, c in found]))


def _merge(k: int, fan_in: int):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        all_ = [np.concatenate([np.frombuffer(x, np.int64) for x in df[c]]) for c in ("rows", "slots", "ids", "scores")]
        at = select(all_[:2], all_[2], all_[3], k)
        x = df.iloc[0]
        return _lists(x["t"], x["dim"], x["g"] // fan_in, *(c[at] for c in all_))
    return run


def _merged(lists: DataFrame, shards: int, k: int, fan_in: int) -> DataFrame:
    while shards > 1:
        lists = lists.groupBy("t", "dim", F.floor(F.col("g") / fan_in)).applyInPandas(_merge(k, fan_in), LISTS)
        shards = -(-shards // fan_in)
    return lists


def _raw_anchors(tile: pd.DataFrame):
    ids, labels, values = (np.concatenate(x) for x in zip(*_blocks(tile)))
    return ids, labels, values, None


def upper_limits(rows: np.ndarray, scores: np.ndarray, n: int, width: int, high: int) -> np.ndarray:
    """Per anchor its positives' upper limits, descending, padded below with the least long."""
    out = np.full((n, width), LONG.min, np.int64)
    start = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n))])
    for i in range(n):
        mine = sorted({_floor(high * int(s), 100) for s in scores[start[i]: start[i + 1]].tolist()}, reverse=True)
        out[i, : len(mine)] = mine
    return out


def _floor(a: int, b: int) -> int:
    return min(max(a // b, LONG.min + 1), LONG.max)


def _tiles(positives: int, high: int):
    """A tile's packed anchors with their positives and upper limits."""
    def run(key: tuple, blocks: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in TILE.split(", ")]
        if blocks.empty or lists.empty:
            return pd.DataFrame(columns=names)
        t, dim = key
        ids, labels, values, _ = _raw_anchors(blocks)
        rows, pids, scores = (np.concatenate([np.frombuffer(x, np.int64) for x in lists[c]]) for c in ("rows", "ids", "scores"))
        limits = upper_limits(rows, scores, len(ids), positives, high)
        return pd.DataFrame([(t, dim, *(x.tobytes() for x in (ids, labels, values, limits, rows, pids, scores)))], columns=names)
    return run


def _tile_anchors(tile: pd.DataFrame):
    r = tile.iloc[0]
    ids = np.frombuffer(r["ids"], np.int64)
    n = len(ids)
    return ids, np.frombuffer(r["labels"], np.int64), np.frombuffer(r["data"], np.float64).reshape(n, r["dim"]), np.frombuffer(r["limits"], np.int64).reshape(n, -1)


def _answers(k: int, low: int, high: int):
    """Descending suffix merges: slot lists become lists up to each upper limit, cut at each positive's lower limit."""
    def run(key: tuple, tile: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in OUT.split(", ")]
        if tile.empty or lists.empty:
            return pd.DataFrame(columns=names)
        ids, _, _, limits = _tile_anchors(tile)
        r = tile.iloc[0]
        prow, pid, pscore = (np.frombuffer(r[c], np.int64) for c in ("rows", "pids", "scores"))
        row, slot, nid, nscore = (np.concatenate([np.frombuffer(x, np.int64) for x in lists[c]]) for c in ("rows", "slots", "ids", "scores"))
        # upto[j]: places of the k best per anchor among scores up to limit j
        upto, below = {}, np.zeros(0, np.int64)
        for j in range(limits.shape[1] - 1, -1, -1):
            both = np.concatenate([np.flatnonzero(slot == j), below])
            below = both[select([row[both]], nid[both], nscore[both], k)]
            upto[j] = below
        out = []
        starts = {j: np.searchsorted(row[p], np.arange(len(ids) + 1)) for j, p in upto.items()}  # places are ordered by anchor
        for i, who, score in zip(prow.tolist(), pid.tolist(), pscore.tolist()):
            j = int(np.flatnonzero(limits[i] == _floor(high * score, 100))[0])
            floor_ = -((-low * score) // 100)
            places = upto[j][starts[j][i]: starts[j][i + 1]]
            rank = 0
            for p in places.tolist():
                if nscore[p] >= floor_:
                    rank += 1
                    out.append((int(ids[i]), who, rank, int(nid[p]), score, int(nscore[p])))
        return pd.DataFrame(out, columns=names)
    return run


def mine(df: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id",
         vec_col: str = "embedding", label: Column | None = None, tile_rows: int = 2048, shard_rows: int = 4096,
         block_rows: int = 256, fan_in: int = 16) -> DataFrame:
    """For every anchor and each of its ``positives`` best rows of the same label,
    the best ``negatives`` rows of other labels whose score is ``low`` to ``high``
    per cent of the positive's: anchor_id, positive_id, rank, negative_id and both scores."""
    spark = df.sparkSession
    ship_package(spark)
    base = df.select(F.col(id_col).cast("long").alias("id"), (F.col("label") if label is None else label).cast("long").alias("label"),
                     F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.col(vec_col).cast("array<double>").alias("vec"))
    base = base.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vec").isNotNull()
                      & ~F.exists(F.coalesce("vec", F.array().cast("array<double>")), lambda x: x.isNull() | F.isnan(x)))
    n, n_a = base.agg(F.count("*"), F.coalesce(F.sum(F.col("anchor").cast("long")), F.lit(0))).first()
    shards, tiles = max(1, -(-n // shard_rows)), max(1, -(-n_a // tile_rows))
    cells = min(shards * tiles, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    tile_of, shard_of = (F.col("home") % tiles).cast("int"), (F.col("home") % shards).cast("int")
    packed = written(base.where("anchor").mapInArrow(_pack(block_rows), PACK).withColumn("t", tile_of), "negatives-anchors")
    cands = (base.mapInArrow(_pack(block_rows), PACK).withColumn("g", shard_of)
             .withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).repartition(cells, "t", "g", "dim"))

    def over_grid(anchors: DataFrame, k: int, anchors_of, candidates_of) -> DataFrame:
        spread = anchors.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(cells, "t", "g", "dim")
        cell = spread.groupBy("t", "g", "dim").cogroup(cands.groupBy("t", "g", "dim")).applyInPandas(_cell(k, anchors_of, candidates_of), LISTS)
        return _merged(cell, shards, k, fan_in)

    best = over_grid(packed, positives, _raw_anchors, _same_label)
    tile = written(packed.groupBy("t", "dim").cogroup(best.groupBy("t", "dim")).applyInPandas(_tiles(positives, high), TILE), "negatives-tiles")
    slots = over_grid(tile, negatives, _tile_anchors, _by_slot)
    return tile.groupBy("t", "dim").cogroup(slots.groupBy("t", "dim")).applyInPandas(_answers(negatives, low, high), OUT)

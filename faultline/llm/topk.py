"""Exact top-k search: tiled matrix products of queries and shards, partial
selection per tile, tree merging of the per-query top lists.

Vectors are packed where they are read into small blocks; a block of candidates
goes to one of G shards, a block of queries to one of T query tiles.  Every
(tile, shard) cell is one bounded matrix product that keeps k rows per query;
the cells' lists are merged ``fan_in`` at a time until one list per query is left.

Defined cases: a row with a null id, and a vector that is null or holds a null
or non-finite component, takes no part.  Vectors are compared with vectors of
their own length only.  Repeated rows count each on their own, as queries and as
candidates, but a query never meets rows of its own id.  Ties go to the smaller
id.  A score beyond the range of a long is returned as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = "dim int, home long, n int, ids binary, data binary, kind string"
LISTS = "t int, dim int, g int, qids binary, rows binary, ids binary, scores binary"
LONG = np.iinfo(np.int64)


def _pack(block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            lists = batch.column("vec")
            lens = np.array([-1 if x is None else x for x in lists.value_lengths().to_pylist()], dtype=np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            start = np.concatenate([[0], np.cumsum(np.maximum(lens, 0))])
            out = []
            for dim in np.unique(lens[lens >= 0]):
                rows = np.flatnonzero(lens == dim)
                m = np.floor(256.0 * flat[start[rows][:, None] + np.arange(dim)])
                fine = np.isfinite(m).all(axis=1)
                rows, m = rows[fine], m[fine]
                for a in range(0, len(rows), block_rows):
                    data = m[a: a + block_rows]
                    top = np.abs(data).max(initial=0)
                    kind = "int16" if top < 2**15 else "int32" if top < 2**31 else "float64"
                    raw, key = data.astype(kind).tobytes(), ids[rows[a: a + block_rows]].astype(np.int64)
                    out.append((int(dim), _home(key, raw), len(data), key.tobytes(), raw, kind))
            if out:
                names = [x.split()[0] for x in BLOCK.split(", ")]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
    return run


def _home(ids: np.ndarray, raw: bytes) -> int:
    """A block's place, from its content alone, so that a rerun finds the same."""
    import xxhash
    return xxhash.xxh64_intdigest(ids.tobytes() + raw, 7) >> 1


def _unpack(df: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of some blocks, in an order that only their content decides."""
    df = df.sort_values(["home", "n"], kind="stable")
    ids = [np.frombuffer(x, np.int64) for x in df["ids"]]
    mats = [np.frombuffer(d, k).astype(np.float64).reshape(n, dim)
            for d, k, n, dim in zip(df["data"], df["kind"], df["n"], df["dim"])]
    return np.concatenate(ids), np.concatenate(mats)


def best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The k best (highest score, then smallest id) of each row."""
    order = np.lexsort((ids, ~scores, rows))  # ~x falls as x rises, without overflow
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
    rank = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    keep = rank < k
    return rows[keep], ids[keep], scores[keep]


def partial(qids, q, cids, c, k: int):
    """Top lists of one tile against one block of candidates."""
    reach = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * max(q.shape[1], 1)
    if reach < 2.0**53:  # every partial sum is an exact double
        s = q @ c.T
    else:
        a, b = ([[int(x) for x in r] for r in m] for m in (q, c))
        s = np.array([[min(max(sum(map(int.__mul__, x, y)), LONG.min), LONG.max) for y in b] for x in a], dtype=np.int64)
    own = qids[:, None] == cids[None, :]
    lowest = -np.inf if s.dtype == np.float64 else LONG.min
    s = np.where(own, lowest, s)
    if s.shape[1] > k:
        bar = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        hit = (s >= bar[:, None]) & ~own
    else:
        hit = ~own
    rows, cols = np.nonzero(hit)
    return best(rows, cids[cols], s[rows, cols].astype(np.int64), k)


def _lists(t, dim, g, qids, rows, ids, scores) -> pd.DataFrame:
    return pd.DataFrame([(t, dim, g, qids.tobytes(), rows.astype(np.int64).tobytes(), ids.astype(np.int64).tobytes(),
                          scores.astype(np.int64).tobytes())], columns=["t", "dim", "g", "qids", "rows", "ids", "scores"])


def _cell(k: int, block_rows: int):
    def run(key: tuple, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        t, g, dim = key
        if queries.empty or shard.empty:
            return pd.DataFrame(columns=["t", "dim", "g", "qids", "rows", "ids", "scores"])
        qids, q = _unpack(queries)
        cids, c = _unpack(shard)
        none = np.zeros(0, np.int64)
        got = (none, none, none)
        for a in range(0, len(cids), block_rows):
            new = partial(qids, q, cids[a: a + block_rows], c[a: a + block_rows], k)
            got = best(*(np.concatenate([x, y]) for x, y in zip(got, new)), k)
        return _lists(t, dim, g, qids, *got)
    return run


def _merge(k: int, fan_in: int):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        rows, ids, scores = (np.concatenate([np.frombuffer(x, np.int64) for x in df[c]]) for c in ("rows", "ids", "scores"))
        x = df.iloc[0]
        return _lists(x["t"], x["dim"], x["g"] // fan_in, np.frombuffer(x["qids"], np.int64), *best(rows, ids, scores, k))
    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            qids = np.frombuffer(r["qids"], np.int64)
            rows, ids, scores = (np.frombuffer(r[c], np.int64) for c in ("rows", "ids", "scores"))
            if len(rows):
                first = np.concatenate([[True], rows[1:] != rows[:-1]])
                rank = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0)) + 1
                yield pa.RecordBatch.from_arrays([pa.array(qids[rows]), pa.array(rank.astype(np.int32)), pa.array(ids), pa.array(scores)],
                                                 names=["query_id", "rank", "vec_id", "score"])


def topk_search(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
                tile_rows: int = 4096, shard_rows: int = 4096, block_rows: int = 512, fan_in: int = 16) -> DataFrame:
    """Top ``k`` rows of ``df`` by integer inner product for every row of
    ``df`` where ``is_query`` holds: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    base = (df.where(F.col(id_col).isNotNull())
            .select(F.col(id_col).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("query"),
                    F.col(vec_col).cast("array<double>").alias("vec")))
    n, n_q = base.agg(F.count("*"), F.coalesce(F.sum(F.col("query").cast("long")), F.lit(0))).first()
    shards, tiles = max(1, -(-n // shard_rows)), max(1, -(-n_q // tile_rows))
    home = F.col("home")
    cells = min(shards * tiles, 16 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    queries = (base.where("query").mapInArrow(_pack(block_rows), BLOCK).withColumn("t", (home % tiles).cast("int"))
               .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).repartition(cells, "t", "g", "dim"))
    cands = (base.mapInArrow(_pack(block_rows), BLOCK).withColumn("g", (home % shards).cast("int"))
             .withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).repartition(cells, "t", "g", "dim"))
    lists = queries.groupBy("t", "g", "dim").cogroup(cands.groupBy("t", "g", "dim")).applyInPandas(_cell(k, block_rows), LISTS)
    while shards > 1:
        lists = lists.groupBy("t", "dim", F.floor(F.col("g") / fan_in)).applyInPandas(_merge(k, fan_in), LISTS)
        shards = -(-shards // fan_in)
    return lists.mapInArrow(_rows, "query_id long, rank int, vec_id long, score long")

"""Per-series ordering at scale: row index (WIN-01), halo blocks for bounded
frames, and the exponential-moving-average scan (WIN-08..10).

Only five API keys exist, so ``Window.partitionBy('api_name')`` would run at
most five tasks, each holding a fifth of the table.  Instead:

1. ``with_row_index`` range-partitions on (key, order) — Spark samples the sort
   key so every task gets an equal slice, even when one key holds most rows —
   numbers rows locally, checkpoints (so recomputation after an executor loss
   sees the same partitioning), and adds per-partition offsets computed on a
   tiny (partition × key) count table.
2. ``blocked`` cuts every series into fixed-size blocks of consecutive rows and
   copies the last ``back`` rows of each block into the next one (and the first
   ``fwd`` rows into the previous one).  A window partitioned by (key, block)
   then sees every row it needs for frames up to ``back`` rows behind and
   ``fwd`` rows ahead.  Work per task is bounded by the block size, not by the
   size of the largest key.
3. EMA is a linear recurrence; inside a block it is a prefix sum of
   ``x_i * q^-i`` rescaled by ``q^j``.  Terms further back than the halo carry
   weight below 2^-64 and vanish in double precision, so the block result
   equals the full recurrence.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import BROADCAST_MAX_ROWS, broadcast_if_small, reliable_checkpoint

LOCAL_BITS = 33
_LOCAL_MASK = (1 << LOCAL_BITS) - 1


def _keys(key) -> list[str]:
    if key is None:
        return []
    return [key] if isinstance(key, str) else list(key)


def _null_safe_on(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    conds = [left[c].eqNullSafe(right[c]) for c in cols]
    return reduce(lambda a, b: a & b, conds)


def _order_number(c: Column, dtype: str) -> Column:
    if dtype.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if dtype == "date":
        return F.unix_date(c).cast("double")
    return c.cast("double")


def _count_below(bounds: Column, x: Column, most: int) -> Column:
    """How many of the ascending ``bounds`` (at most ``most``) are below ``x``, by
    halving: a null ``x`` has none below it."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(most.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(bounds, at + step - 1) < x, at + step).otherwise(at))


def with_row_index(df: DataFrame, key="api_name", order=("timestamp", "event_id"),
                   idx_col: str = "row_idx", n_partitions: int | None = None) -> DataFrame:
    """0-based position of each row inside its series (``key``) by ``order``.

    ``order`` must make rows unique within a key (include an id tie-breaker).
    Each key's range of the first order column is cut at approximate
    quantiles into ``n`` buckets (a tiny boundary table, checkpointed so every
    job sees the same cuts), a key's buckets are dealt to the tasks in turn and
    sorted — so a hot key is spread over many tasks — and numbered locally;
    per-(key, bucket) counts (a small table) give the offsets.  Everything
    downstream of the checkpointed boundaries is deterministic, so lost
    partitions recompute to the same numbers.
    """
    keys = _keys(key)
    order = list(order)
    spark = df.sparkSession
    n = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dtypes = dict(df.dtypes)
    prefix = []                       # leading string order columns act as extra grouping
    for c in order:
        if dtypes[c] == "string":
            prefix.append(c)
        else:
            break
    rest = order[len(prefix):]
    bkeys = keys + prefix
    ordnum = _order_number(F.col(rest[0]), dtypes[rest[0]])
    probs = [i / n for i in range(1, n)]
    if probs:
        bnd = df.groupBy(*bkeys).agg(F.percentile_approx(ordnum, probs, 10000).alias("_b")) if bkeys else \
            df.agg(F.percentile_approx(ordnum, probs, 10000).alias("_b"))
        bnd = reliable_checkpoint(bnd.select(*[F.col(k).alias(f"_k_{k}") for k in bkeys], "_b"))
        n_keys = bnd.count()            # tiny, checkpointed table
        if bkeys:
            bnd = F.broadcast(bnd) if n_keys <= BROADCAST_MAX_ROWS else bnd
            cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(bnd[f"_k_{k}"]) for k in bkeys])
            d = df.join(bnd, cond, "left").drop(*[f"_k_{k}" for k in bkeys])
        else:   # one row with the n-1 boundaries; as a literal, the bucket would be a function of
                # the order column alone, and the optimizer infers it on the offsets' side too
            d = df.crossJoin(F.broadcast(bnd))
        d = d.withColumn("_bucket", _count_below(F.coalesce(F.col("_b"), F.array().cast("array<double>")), ordnum, n - 1)).drop("_b")
    else:
        n_keys = df.select(*bkeys).distinct().count() if bkeys else 1
        d = df.withColumn("_bucket", F.lit(0))
    # a key's buckets go to the tasks in turn; where each (key, bucket) begins follows from
    # the counts alone, so the rows are shuffled and sorted once
    task = F.pmod(F.hash(*bkeys).cast("long") + F.col("_bucket") if bkeys else F.col("_bucket").cast("long"), F.lit(n)).cast("int")
    ranged = (d.repartitionById(n, task)
              .sortWithinPartitions(*keys, *prefix, "_bucket", *rest)
              .withColumn("_mid", F.monotonically_increasing_id()))
    local = F.col("_mid").bitwiseAND(F.lit(_LOCAL_MASK))
    seg = d.groupBy(*bkeys, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_task", task)
    before = lambda *by: Window.partitionBy(*by).orderBy(*keys, *prefix, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    for name, by in (("_off", keys), ("_first", ["_task"])):
        seg = seg.withColumn(name, F.coalesce(F.sum("_n").over(before(*by)), F.lit(0)))
    # a small table, written once
    seg = reliable_checkpoint(seg.select(*[F.col(k).alias(f"_k_{k}") for k in bkeys], F.col("_bucket").alias("_kb"), "_off", "_first"))
    # at most n rows per key: broadcast on that proven bound (no extra job)
    if n_keys * n <= BROADCAST_MAX_ROWS:
        seg = F.broadcast(seg)
    left = ranged.withColumn("_local", local)
    cond = left["_bucket"] == seg["_kb"]
    for k in bkeys:
        cond = cond & left[k].eqNullSafe(seg[f"_k_{k}"])
    out = left.join(seg, cond, "inner")
    out = out.withColumn(idx_col, F.col("_off") + F.col("_local") - F.col("_first"))
    return out.drop("_mid", "_local", "_off", "_first", "_bucket", "_kb", *[f"_k_{k}" for k in bkeys])


def blocked(df: DataFrame, idx_col: str = "row_idx", block: int = 2048,
            back: int = 0, fwd: int = 0) -> DataFrame:
    """Assign ``_blk`` and replicate halo rows; ``_home`` marks the original."""
    if back > block or fwd > block:
        raise ValueError("halo larger than block")
    i = F.col(idx_col)
    b = F.floor(i / F.lit(block)).cast("long")
    pos = i - b * F.lit(block)
    targets = F.array(
        F.struct(b.alias("blk"), F.lit(True).alias("home")),
        F.when(pos >= F.lit(block - back), F.struct((b + 1).alias("blk"), F.lit(False).alias("home"))) if back > 0
        else F.lit(None).cast("struct<blk:bigint,home:boolean>"),
        F.when((pos < F.lit(fwd)) & (b > 0), F.struct((b - 1).alias("blk"), F.lit(False).alias("home"))) if fwd > 0
        else F.lit(None).cast("struct<blk:bigint,home:boolean>"),
    )
    t = F.explode(F.filter(targets, lambda x: x.isNotNull())).alias("_t")
    return df.select("*", t).select("*", F.col("_t.blk").alias("_blk"),
                                    F.col("_t.home").alias("_home")).drop("_t")


def block_window(key="api_name", idx_col: str = "row_idx"):
    return Window.partitionBy(*_keys(key), "_blk").orderBy(idx_col)


# --- EMA -------------------------------------------------------------------------
def ema_q(span: float) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def ema_halo(span: float, bits: int = 64) -> int:
    """Rows after which older terms weigh less than 2^-bits."""
    q = ema_q(span)
    return int(math.ceil(bits * math.log(2) / -math.log(q)))


def ema_block_size(spans, back: int, fwd: int = 0) -> int:
    """Largest power-of-two block keeping q^-j finite inside a block."""
    lnq = max(-math.log(ema_q(s)) for s in spans) if spans else 1e-9
    limit = int(690 / lnq) - back - fwd
    size = 1 << max(6, int(math.floor(math.log2(max(limit, 64)))))
    while size > limit and size > 64:
        size >>= 1
    return max(size, back, fwd, 64)


def ema_columns(x: Column, span: float, w, idx_col: str = "row_idx",
                adjust: bool = True, seed: str = "first") -> Column:
    """EMA of ``x`` over the block window ``w`` (ordered by the global index).

    adjust=True : sum q^(t-i) x_i / sum q^(t-i)          (pandas ewm adjust=True)
    adjust=False: e_0 = x_0, e_t = a x_t + q e_{t-1}     (pandas adjust=False)
    seed='zero' : e_-1 = 0,  e_t = a x_t + q e_{t-1}
    """
    q = ema_q(span)
    alpha = 1.0 - q
    j = (F.row_number().over(w) - 1).cast("double")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    s = F.sum(x * F.pow(F.lit(q), -j)).over(run)
    n = s * F.pow(F.lit(q), j)
    t = F.col(idx_col).cast("double")
    if adjust:
        d = (F.lit(1.0) - F.pow(F.lit(q), t + 1)) / F.lit(1.0 - q)
        # The first two positions are evaluated directly (fewer rounding steps:
        # exact for row 0, one fused step for row 1).
        prev = F.lag(x, 1).over(w)
        return (F.when(t == 0, x)
                .when(t == 1, (x + F.lit(q) * prev) / F.lit(1.0 + q))
                .otherwise(n / d))
    if seed == "zero":
        return F.lit(alpha) * n
    x0 = F.first(x).over(run)
    return F.lit(alpha) * n + F.pow(F.lit(q), t + 1) * x0


# --- distributed prefix sums ------------------------------------------------------------
def cumulative(df: DataFrame, group, order, sums, desc: bool = False,
               n_partitions: int | None = None, agg: str = "sum") -> DataFrame:
    """Inclusive running sums of ``sums`` along ``order`` within ``group``.

    Exact and distributed: range-partition on (group, order) so each task owns a
    contiguous, balanced slice; checkpoint so the slices are stable; running sums
    inside each (partition, group); add the totals of earlier partitions of the
    same group from a tiny per-partition table.  No task ever holds a whole
    group, however skewed.  ``order`` values must be unique within a group
    (aggregate to distinct values first).
    """
    keys = _keys(group)
    spark = df.sparkSession
    n = n_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = [F.col(c).desc() if desc else F.col(c).asc() for c in order]
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *o).withColumn("_pid", F.spark_partition_id())
    ranged = reliable_checkpoint(ranged)
    fn = F.sum if agg == "sum" else F.max
    tot = ranged.groupBy("_pid", *keys).agg(*[fn(c).alias(f"_t_{c}") for c in sums])
    wo = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0) if agg == "sum" else F.lit(None)
    tot = tot.select("_pid", *keys, *[F.coalesce(fn(f"_t_{c}").over(wo), zero).alias(f"_o_{c}")
                                      for c in sums])
    wl = Window.partitionBy("_pid", *keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", *[fn(c).over(wl).alias(f"_l_{c}") for c in sums])
    out = local.join(broadcast_if_small(tot), ["_pid", *keys], "inner")
    comb = ((lambda c: F.col(f"_l_{c}") + F.col(f"_o_{c}")) if agg == "sum"
            else (lambda c: F.greatest(F.col(f"_l_{c}"), F.col(f"_o_{c}"))))
    out = out.select("*", *[comb(c).alias(f"cum_{c}") for c in sums])
    return out.drop("_pid", *[f"_l_{c}" for c in sums], *[f"_o_{c}" for c in sums])


# --- exact order statistics -------------------------------------------------------------
def kth_values(df: DataFrame, col: str, ks) -> dict:
    """Exact k-th smallest values (0-based ranks) of ``col``: the column is
    reduced to distinct values with counts, these get distributed running
    counts, and only the rows that hold a rank reach the driver (one a rank)."""
    c = value_counts(df.select(F.col(col).cast("double").alias("_v")), "_v")
    cum = cumulative(c, None, ["_v"], ["_c"])
    want = F.array(*[F.lit(int(k)).cast("long") for k in ks])
    held = F.filter(want, lambda k: (k >= F.col("cum__c") - F.col("_c")) & (k < F.col("cum__c")))
    out: dict = {k: None for k in ks}
    for r in cum.select("_v", F.explode(held).alias("k")).distinct().collect():
        out[r["k"]] = r["_v"]
    return out


def value_counts(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Distinct values (per group) with their counts ``_c``; nulls and NaN left out."""
    return (df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c")))

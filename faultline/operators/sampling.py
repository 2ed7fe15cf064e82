"""Sampling, splitting and rebalancing (SMP-01..13) on hash order.

The reference draws with numpy's RNG; here every "random" choice is the
order of a seeded per-row hash uniform (SCL-16) with the row id as tie-break,
so results are deterministic, distributed and reproducible by SQL
(``ORDER BY u, id``).  Exact-size selection uses distributed order statistics
(``series.kth_values``) instead of a global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import constants as C
from faultline.functions.scalars import hash_normal, hash_uniform
from faultline.operators import series


def with_u(df: DataFrame, seed, id_col: str = "event_id", out: str = "_u") -> DataFrame:
    return df.withColumn(out, hash_uniform(F.col(id_col), seed))


def sample_n(df: DataFrame, n: int, seed="sample", id_col: str = "event_id") -> DataFrame:
    """SMP-01: exactly ``n`` rows without replacement — the n smallest (u, id).

    Threshold = n-th smallest u by distributed selection; rows below it are
    kept, and the few rows tied at the threshold (hash collisions) are cut by
    id.  No global sort, no row cap besides n itself.
    """
    d = with_u(df, seed, id_col)
    if n <= 0:
        return d.limit(0).drop("_u")
    total = d.count()
    if n >= total:
        return d.drop("_u")
    t = series.kth_values(d, "_u", [n - 1])[n - 1]
    below = d.filter(F.col("_u") < t)
    c = below.count()
    ties = d.filter(F.col("_u") == t).orderBy(id_col).limit(n - c)
    return below.unionByName(ties).drop("_u")


def stratified_sample(df: DataFrame, label: str, max_rows: int, seed="strat",
                      id_col: str = "event_id") -> DataFrame:
    """SMP-02: keep the label ratio: n_pos = min(#pos, int(max*rate)),
    n_neg = min(#neg, max - n_pos)."""
    cnt = {r[0]: r[1] for r in df.groupBy(label).count().collect()}   # two strata
    total = sum(cnt.values())
    n_pos_all, n_neg_all = cnt.get(1, 0), cnt.get(0, 0)
    rate = n_pos_all / max(total, 1)
    n_pos = min(n_pos_all, int(max_rows * rate))
    n_neg = min(n_neg_all, max_rows - n_pos)
    pos = sample_n(df.filter(F.col(label) == 1), n_pos, seed, id_col)
    neg = sample_n(df.filter(F.col(label) == 0), n_neg, seed, id_col)
    return pos.unionByName(neg)


def cap_group_share(df: DataFrame, value: str, cap: float = 0.25, col: str = "api_name",
                    seed="cap_share", id_col: str = "event_id") -> DataFrame:
    """SMP-03: drop only success rows of group ``value`` so that it holds at
    most ``cap`` of the rows: X = int((cap*others - (1-cap)*fail)/(1-cap)), >= 0."""
    g = df.agg(F.sum(F.when(F.col(col) != value, 1).otherwise(0)).alias("others"),
               F.sum(F.when((F.col(col) == value) & (F.col("success") == 0), 1).otherwise(0)).alias("fail"),
               F.sum(F.when((F.col(col) == value) & (F.col("success") == 1), 1).otherwise(0)).alias("succ")).first()
    others, fail, succ = g["others"] or 0, g["fail"] or 0, g["succ"] or 0
    x = max(0, int((cap * others - (1 - cap) * fail) / (1 - cap)))
    if x >= succ:
        return df
    keep = df.filter((F.col(col) != value) | (F.col("success") == 0))
    kept_succ = sample_n(df.filter((F.col(col) == value) & (F.col("success") == 1)), x, seed, id_col)
    return keep.unionByName(kept_succ)


def cap_failure_rate(df: DataFrame, cap: float = 0.20, seed="cap_fail", id_col: str = "event_id") -> DataFrame:
    """SMP-04: if the failure rate exceeds ``cap`` keep int(n_success*cap)
    failures (the resulting rate is cap/(1+cap))."""
    g = df.agg(F.sum(F.coalesce(F.col("success"), F.lit(1))).alias("succ"),
               F.count(F.lit(1)).alias("n")).first()
    succ, n = g["succ"] or 0, g["n"]
    if n == 0 or 1.0 - succ / n <= cap:
        return df
    target = int(succ * cap)
    return df.filter(F.col("success") == 1).unionByName(
        sample_n(df.filter(F.col("success") == 0), target, seed, id_col))


def balance(df: DataFrame, label: str = "y", seed="balance", id_col: str = "event_id") -> DataFrame:
    """SMP-05: downsample negatives to the number of positives (skipped when
    there are no positives or positives >= negatives)."""
    cnt = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    pos, neg = cnt.get(1, 0), cnt.get(0, 0)
    if pos == 0 or neg <= pos:
        return df
    return df.filter(F.col(label) == 1).unionByName(sample_n(df.filter(F.col(label) == 0), pos, seed, id_col))


def oversample(df: DataFrame, factor: float, label: str = "y", seed="oversample",
               id_col: str = "event_id") -> DataFrame:
    """SMP-06: add round(n_pos*(factor-1)) positive rows: whole copies via
    ``explode(sequence)``, the remainder by hash order.  ``copy`` = 0 for
    originals.  (Re-specified without replacement per copy.)"""
    pos = df.filter(F.col(label) == 1)
    n_pos = pos.count()
    extra = int(round(n_pos * (factor - 1.0)))
    base = df.withColumn("copy", F.lit(0))
    if n_pos == 0 or extra <= 0:
        return base
    full, rem = divmod(extra, n_pos)
    parts = [base]
    if full:
        parts.append(pos.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(full)))))
    if rem:
        parts.append(sample_n(pos, rem, seed, id_col).withColumn("copy", F.lit(full + 1)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def jitter(df: DataFrame, scale: float, seed, id_col: str = "event_id", copy_col: str | None = None,
           cols=C.JITTER_COLS) -> DataFrame:
    """Multiplicative gaussian noise (1 + N(0, scale)), clipped at 0; request
    count +U{-3..3}, at least 1.  Noise is a hash of (id, copy)."""
    key = F.col(id_col).cast("string") if copy_col is None else \
        F.concat(F.col(id_col).cast("string"), F.lit("/"), F.col(copy_col).cast("string"))
    out = df
    for i, c in enumerate([c for c in cols if c in df.columns]):
        noise = F.lit(1.0) + hash_normal(key, f"{seed}:{c}") * F.lit(scale)
        out = out.withColumn(c, F.greatest(F.col(c).cast("double") * noise, F.lit(0.0)))
    if "request_count" in df.columns:
        step = F.floor(hash_uniform(key, f"{seed}:rc") * 7).cast("int") - 3
        out = out.withColumn("request_count", F.greatest(F.col("request_count") + step, F.lit(1)))
    return out


def augment_group(df: DataFrame, pred: Column, copies: int = C.OVERSAMPLE_FACTOR, scale: float = 0.05,
                  scale_step: float = 0.01, cap_fraction: float = C.MAX_AUGMENTATION_FRACTION,
                  seed="augment", id_col: str = "event_id") -> DataFrame:
    """SMP-07: ``copies`` jittered copies of the rows matching ``pred`` (copy i
    uses scale + i*scale_step), at most cap_fraction of the pool — beyond it an
    exact sample of all copies, in hash order of (id, copy)."""
    pool_n = df.count()
    cap = int(pool_n * cap_fraction)
    src = df.filter(pred)
    cp = src.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    cp = cp.withColumn("_scale", F.lit(scale) + F.col("copy") * F.lit(scale_step))
    noisy = cp
    for c in [c for c in C.JITTER_COLS if c in df.columns]:
        key = F.concat(F.col(id_col).cast("string"), F.lit("/"), F.col("copy").cast("string"))
        noisy = noisy.withColumn(c, F.greatest(F.col(c).cast("double") * (
            F.lit(1.0) + hash_normal(key, f"{seed}:{c}") * F.col("_scale")), F.lit(0.0)))
    if "request_count" in df.columns:
        key = F.concat(F.col(id_col).cast("string"), F.lit("/"), F.col("copy").cast("string"))
        noisy = noisy.withColumn("request_count", F.greatest(
            F.col("request_count") + F.floor(hash_uniform(key, f"{seed}:rc") * 7).cast("int") - 3, F.lit(1)))
    noisy = noisy.drop("_scale")
    n_added = src.count() * copies
    if n_added > cap:
        name = F.concat(F.col(id_col).cast("string"), F.lit("/"), F.col("copy").cast("string"))
        noisy = sample_n(noisy.withColumn("_name", name), cap, f"{seed}:cap", "_name").drop("_name")
    return df.withColumn("copy", F.lit(-1)).unionByName(noisy)


def inject_failures(df: DataFrame, target_rate: float = C.TARGET_FAILURE_RATE, scale: float = 0.06,
                    seed="inject", id_col: str = "event_id") -> DataFrame:
    """SMP-08: add int(N*target) - n_fail jittered failures drawn from the
    existing failures (cycled copies + hash-ordered remainder)."""
    n = df.count()
    fails = df.filter(F.col("success") == 0)
    nf = fails.count()
    n_inject = max(0, int(n * target_rate) - nf)
    if n_inject == 0 or nf == 0:
        return df.withColumn("copy", F.lit(-1))
    extra = oversample(fails.withColumn("_y", F.lit(1)), 1.0 + n_inject / nf, "_y", seed, id_col)
    extra = extra.filter(F.col("copy") > 0).drop("_y")
    extra = jitter(extra, scale, seed, id_col, "copy")
    return df.withColumn("copy", F.lit(-1)).unionByName(extra)


def split_stratified(df: DataFrame, label: str, fractions=(0.8, 0.1, 0.1), seed="split",
                     id_col: str = "event_id", names=("train", "val", "test")) -> DataFrame:
    """SMP-09: per stratum, rank rows by hash (distributed row index) and cut
    at floor(n_s * cumulative fraction)."""
    d = with_u(df, seed, id_col)
    idx = series.with_row_index(d, key=label, order=("_u", id_col), idx_col="_r")
    n = d.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    j = idx.join(F.broadcast(n), label)
    cum = 0.0
    expr = None
    for frac, name in zip(fractions[:-1], names[:-1]):
        cum += frac
        cond = F.col("_r") < F.floor(F.col("_n") * F.lit(cum))
        expr = F.when(cond, name) if expr is None else expr.when(cond, name)
    expr = expr.otherwise(names[-1]) if expr is not None else F.lit(names[-1])
    return j.withColumn("split", expr).drop("_u", "_r", "_n")


def kfold(df: DataFrame, k: int, seed="kfold", id_col: str = "event_id") -> DataFrame:
    """SMP-11: fold = floor(u * k)."""
    return df.withColumn("fold", F.floor(hash_uniform(F.col(id_col), seed) * k).cast("int"))


def shuffle(df: DataFrame, seed="shuffle", id_col: str = "event_id") -> DataFrame:
    """SMP-12: full permutation = sort by (u, id) (range-partitioned sort)."""
    return with_u(df, seed, id_col).orderBy("_u", id_col).drop("_u")


def quota_pool(df: DataFrame, n_total: int, key: str = "api_name", seed="pool",
               id_col: str = "event_id") -> DataFrame:
    """SMP-13: n_total // #groups rows per group by hash order, then the pool
    trimmed to n_total by hash order.  ``row_number() <= quota`` is planned as
    a per-partition group limit before the shuffle."""
    from pyspark.sql import Window
    groups = df.select(key).distinct().count()
    per = n_total // max(groups, 1)
    d = with_u(df, seed, id_col)
    w = Window.partitionBy(key).orderBy("_u", id_col)
    pool = d.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per).drop("_rn")
    return pool.orderBy("_u", id_col).limit(n_total).drop("_u")

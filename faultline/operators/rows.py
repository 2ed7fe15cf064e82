"""Row filters, splits, sequence summaries and SQL functions (FLT-01/02/05,
PRJ-01/06, SMP-10, WIN-22/23/25, TOP-07, UDF-01)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from faultline import constants as C
from faultline.functions.scalars import hash_uniform
from faultline.operators import series


def between_dates(df: DataFrame, start: str, end: str, ts: str = "timestamp") -> DataFrame:
    """FLT-01: both ends included, the end being midnight of its day."""
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def before(df: DataFrame, cutoff: str, ts: str = "timestamp") -> DataFrame:
    """FLT-02."""
    return df.where(F.col(ts) < F.lit(cutoff).cast("timestamp_ntz"))


def min_group_size(df: DataFrame, key: str, n: int) -> DataFrame:
    """FLT-05: rows of groups with at least ``n`` rows (counts are joined, so no
    group is gathered)."""
    big = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(key)
    return df.join(big, key, "left_semi")


def available(df: DataFrame, cols) -> tuple[DataFrame, list[str]]:
    """PRJ-01: the listed columns that exist, and the names of those that do not."""
    return df.select(*[c for c in cols if c in df.columns]), [c for c in cols if c not in df.columns]


def narrow(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """PRJ-06: cast columns to narrower types; others stay."""
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in df.columns})


def random_split(df: DataFrame, share: float, seed="split", id_col: str = "event_id", out: str = "part") -> DataFrame:
    """SMP-10: unstratified, by a hash of the id."""
    return df.withColumn(out, F.when(hash_uniform(F.col(id_col), seed) < share, "train").otherwise("test"))


def ordered_split(df: DataFrame, shares=(0.7, 0.15, 0.15), order=("timestamp", "event_id"), out: str = "part") -> DataFrame:
    """SMP-10: first 70 % in order train, next 15 % validation, the rest test."""
    idx = series.with_row_index(df, key=None, order=order, idx_col="_i")
    n = df.count()
    a, b = int(n * shares[0]), int(n * shares[0]) + int(n * shares[1])
    return idx.withColumn(out, F.when(F.col("_i") < a, "train").when(F.col("_i") < b, "val").otherwise("test")).drop("_i")


def _summaries(x, known, place, length: int):
    """Mean and slope of every window of ``length`` rows of ``x`` (``known``: which rows
    have a value), with which of both are null.  Row by row from the oldest, as avg and
    regr_slope do it, for all windows at once."""
    n = len(x) - length + 1
    total, x_mean, p_mean, both, squares, count = (np.zeros(n) for _ in range(6))
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        for k in range(length):
            v, p, ok = x[k: k + n], place[k: k + n], known[k: k + n]
            more = count + 1.0
            dp, dx = p - p_mean, v - x_mean
            step_p, step_x = dp / more, dx / more
            now = (total + v, x_mean + step_x, p_mean + step_p, both + dp * (v - (x_mean + step_x)), squares + dp * (dp - step_p), more)
            if ok.all():
                total, x_mean, p_mean, both, squares, count = now
            else:
                total, x_mean, p_mean, both, squares, count = (
                    np.where(ok, new, old) for new, old in zip(now, (total, x_mean, p_mean, both, squares, count)))
        return total / count, count == 0, both / squares, squares == 0


def _block_summaries(cols, length: int, step: int, horizons, kept):
    """One block of consecutive rows -> its windows (Arrow tables in and out)."""
    def run(block: pa.Table) -> pa.Table:
        block = block.take(pc.sort_indices(block["row_idx"])).combine_chunks()
        at, rows = block["row_idx"].to_numpy(), np.arange(block.num_rows)
        bad = {h: block["_bad"].take(pa.array(rows + h, mask=rows + h >= len(rows))) for h in horizons}
        full = block["_home"].to_numpy() & (rows >= length - 1) & ((at - (length - 1)) % step == 0)
        ends = rows[full & bad[max(horizons)].is_valid().to_numpy()]
        out = {c: block[c].take(pa.array(ends)) for c in kept}
        for c in cols if len(ends) else ():
            x = pc.cast(block[c], pa.float64(), safe=False)
            stats = _summaries(x.fill_null(0.0).to_numpy(), x.is_valid().to_numpy(), at.astype(float), length)
            mean, no_mean, slope, no_slope = (s[ends - (length - 1)] for s in stats)
            out |= {f"{c}_mean": pa.array(mean, mask=no_mean), f"{c}_last": block[c].take(pa.array(ends)),
                    f"{c}_slope": pa.array(slope, mask=no_slope)}
        if not len(ends):
            out |= {f"{c}_{k}": block[c].slice(0, 0) if k == "last" else pa.array([], pa.float64())
                    for c in cols for k in ("mean", "last", "slope")}
        return pa.table(out | {f"y_h{h}": y.take(pa.array(ends)) for h, y in bad.items()})
    return run


def sequence_summaries(df: DataFrame, cols, length: int = 30, step: int = 1, horizons=(1, 5, 15), key: str = "api_name",
                       order=("timestamp", "event_id")) -> DataFrame:
    """WIN-22/23: for every full window of ``length`` rows (each ``step`` rows):
    mean, last and slope per row of the columns, and whether the row 1, 5 or 15
    after the window fails; windows without all targets are left out.  Windows run inside blocks with a halo, so one hot
    series is spread over many tasks; a block's windows are summed side by side as arrays."""
    kept = list(dict.fromkeys(["event_id", key, "row_idx"]))
    idx = series.with_row_index(df.select(*dict.fromkeys(["event_id", key, *order, "success", *cols])), key=key, order=order)
    b = series.blocked(idx, block=4096, back=length - 1, fwd=max(horizons))
    b = b.select(*dict.fromkeys([*kept, *cols, "_blk", "_home"]), (F.lit(1) - F.col("success")).cast("int").alias("_bad"))
    out = [StructField(c, b.schema[c].dataType) for c in kept]
    for c in cols:
        out += [StructField(f"{c}_mean", DoubleType()), StructField(f"{c}_last", b.schema[c].dataType), StructField(f"{c}_slope", DoubleType())]
    out += [StructField(f"y_h{h}", IntegerType()) for h in horizons]
    return b.groupBy(key, "_blk").applyInArrow(_block_summaries(list(cols), length, step, tuple(horizons), kept), StructType(out))


def running_best(df: DataFrame, value: str, order: str, out: str = "improved") -> DataFrame:
    """WIN-25: first, or lower than every earlier value (``df``: one row a period)."""
    cum = series.cumulative(df.withColumn("_neg", -F.col(value)), None, [order], ["_neg"], agg="max")
    prior = cum.select(F.col(order).alias("_o"), F.col("cum__neg").alias("_best"))
    pos = series.with_row_index(df, key=None, order=(order,), idx_col="_i")
    nxt = prior.join(pos.select(F.col(order).alias("_o"), (F.col("_i") + 1).alias("_j")), "_o").select("_j", "_best")
    return (pos.join(nxt, F.col("_i") == F.col("_j"), "left")
            .withColumn(out, F.col("_best").isNull() | (-F.col(value) > F.col("_best"))).drop("_i", "_j", "_best"))


def top_risk(df: DataFrame, n: int = 3, risk: str = "p", high: float = C.HIGH_RISK, key: str = "api_name", order: str = "row_idx") -> DataFrame:
    """TOP-07: per key the ``n`` riskiest rows at or above ``high``; the first
    ``n`` rows of keys that have none (row_number limits are applied before the shuffle)."""
    by_risk = Window.partitionBy(key).orderBy(F.col(risk).desc(), F.col(order))
    hot = df.where(F.col(risk) >= high).withColumn("rank", F.row_number().over(by_risk)).where(F.col("rank") <= n)
    first = df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("rank") <= n)
    return hot.unionByName(first.join(hot.select(key).distinct(), key, "left_anti"))


SQL_FUNCTIONS = {
    "risk_label": ("p DOUBLE", "STRING", "CASE WHEN p >= 0.65 THEN 'HIGH' WHEN p >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END"),
    "logistic": ("x DOUBLE", "DOUBLE", "1.0D / (1.0D + exp(-x))"),
    "request_ok": ("status INT", "INT", "CASE WHEN status < 400 THEN 1 ELSE 0 END"),
}


def register_functions(spark: SparkSession) -> list[str]:
    """UDF-01: the scalar rules as SQL functions (plain expressions, inlined by
    the optimizer)."""
    for name, (args, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(SQL_FUNCTIONS)

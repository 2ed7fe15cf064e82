"""Session helpers: building a local session for tests/bench, reliable
checkpointing, and size-checked broadcast.

On a cluster the session is given to us; we only read its settings.  The
checkpoint folder comes from ``spark.checkpoint.dir`` (a shared, fault-tolerant
location named by the cluster).  A folder is only set here when that setting is
missing, which is the case in local tests.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Upper bounds for a side we are willing to broadcast after counting it.
BROADCAST_MAX_BYTES = 64 << 20
BROADCAST_MAX_ROWS = 2_000_000  # for sides of a few numbers a row


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "faultline") -> SparkSession:
    """Session for tests and the bench (local mode, UI off, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting a scratch one only if unset."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="faultline-ckpt-", dir="/tmp")
    sc.setCheckpointDir(conf_dir)
    return conf_dir


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back:
    lineage is cut, and later stages see exactly the same rows even if an
    executor is lost; they read only the columns they use.
    """
    path = scratch_dir(df.sparkSession, "table")
    df.write.option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Broadcast ``df`` only when a count proves it is small: rows times the
    width of its columns (strings and nested values count 64 bytes).

    The count runs on an already-aggregated (small) DataFrame; callers pass
    only such inputs.  Beyond the bound a shuffle join is asked for: left alone, the
    planner broadcasts by size on disk, and compressed columns of few values are
    a tenth there of what they take on the driver.
    """
    width = sum(8 if t in ("int", "bigint", "double", "float", "date", "timestamp", "timestamp_ntz", "boolean", "smallint", "tinyint") else 64
                for _, t in df.dtypes)
    return F.broadcast(df) if df.count() * width <= max_bytes else df.hint("merge")


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package (once per Spark context), so that Python
    functions run there whatever their working directory is."""
    import zipfile

    import faultline

    sc = spark.sparkContext
    if getattr(sc, "_faultline_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(faultline.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="faultline-py-"), "faultline.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    path = os.path.join(folder, n)
                    z.write(path, os.path.join("faultline", os.path.relpath(path, root)))
    sc.addPyFile(archive)  # served to the executors by the driver
    sc._faultline_shipped = True


def sf_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never a
    machine-local temp folder on a cluster) for files a plan writes and reads."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/faultline-scratch/{name}-{uuid.uuid4().hex[:12]}"

"""File sources and sinks (SRC-01..09, SNK-01..06).

Readers always pass an explicit schema (no inference pass over the data),
tolerate malformed input the way the reference does (bad rows dropped or
fields nulled), and leave pruning / filter push-down to the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TELEMETRY_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("api_name", T.StringType()),
    T.StructField("response_time", T.DoubleType()),
    T.StructField("status_code", T.IntegerType()),
    T.StructField("success", T.IntegerType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("request_count", T.IntegerType()),
])

HEAL_LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("mode", T.StringType()),
    T.StructField("data", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("problems_found", T.StructType([
        T.StructField("drift_detected", T.BooleanType()),
        T.StructField("imbalance_detected", T.BooleanType()),
        T.StructField("worst_api", T.StringType()),
        T.StructField("drift_report", T.MapType(T.StringType(), T.StructType([
            T.StructField("ks", T.DoubleType()), T.StructField("p", T.DoubleType()),
            T.StructField("drifted", T.BooleanType())]))),
    ])),
    T.StructField("fixes_applied", T.ArrayType(T.StringType())),
    T.StructField("comparison", T.StructType([
        T.StructField("old_auc", T.DoubleType()), T.StructField("new_auc", T.DoubleType()),
        T.StructField("delta", T.DoubleType())])),
    T.StructField("outcome", T.StructType([T.StructField("promoted", T.BooleanType())])),
])


def read_telemetry_csv(spark: SparkSession, path: str, schema: T.StructType = TELEMETRY_SCHEMA) -> DataFrame:
    """SRC-01: header CSV; timestamps coerced (unparsable -> NULL)."""
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.withColumn("timestamp", F.try_to_timestamp(F.col("timestamp")))


def read_pruned(spark: SparkSession, path: str, cols, n: int | None = None, fmt: str = "parquet") -> DataFrame:
    """SRC-02: column-pruned scan (ReadSchema = cols), optionally row-capped."""
    df = spark.read.format(fmt).load(path).select(*cols)
    return df.limit(n) if n else df


def read_folder(spark: SparkSession, path: str, schema: T.StructType, pattern: str = "*.csv",
                priority=("ec2", "latency", "cloudwatch"), max_files: int | None = None) -> DataFrame:
    """SRC-03: recursive discovery; files ranked by (priority match, size desc);
    all are read unless ``max_files`` asks for the top ones (a file-level choice
    from ``_metadata``; the ranking sees one row a file)."""
    df = (spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True)
          .option("pathGlobFilter", pattern).csv(path)
          .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_size")))
    if max_files is None:
        return df
    files = df.select("_file", "_size").distinct()
    pr = F.greatest(*[F.lower("_file").contains(p).cast("int") for p in priority]) if priority else F.lit(0)
    w = Window.orderBy(pr.desc(), F.col("_size").desc(), F.col("_file"))
    top = files.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= max_files).select("_file")
    return df.join(F.broadcast(top), "_file", "left_semi")


def read_headerless(spark: SparkSession, path: str, names, types=None) -> DataFrame:
    """SRC-04: headerless CSV/TXT(.gz) with supplied column names."""
    types = types or ["string"] * len(names)
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in zip(names, types)])
    return spark.read.schema(schema).option("header", False).csv(path)


def read_csv_tolerant(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
                      header: bool = True, strict: bool = False) -> DataFrame:
    """SRC-05: skip lines with more fields than the schema; shorter lines are kept,
    their missing fields null, as empty fields are, the last one too.  A field
    that does not parse becomes null; with ``strict`` its line is skipped too.
    Quoted fields may hold the separator."""
    # the parser marks lines by their number of fields, if it reads them all
    wide = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields] + [T.StructField("_malformed", T.StringType())])
    raw = (spark.read.schema(wide).option("header", header).option("sep", sep).option("enforceSchema", True)
           .option("columnNameOfCorruptRecord", "_malformed").option("columnPruning", False)
           .option("nullValue", "\u0001").option("emptyValue", "").csv(path))
    typed = raw.select(*[F.col(f.name).alias(f"_r{i}") for i, f in enumerate(schema.fields)], "_malformed",
                       *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
    # never true (such a field is null): Spark wants another column read beside the mark, for counts too
    bare = F.regexp_replace("_malformed", '"([^"]|"")*"', "")  # quoted fields may hold the separator
    too_long = F.col("_malformed").isNotNull() & (F.size(F.split(bare, re.escape(sep))) > len(schema.fields))
    bad = F.coalesce(too_long, F.lit(False)) | F.col("_r0").eqNullSafe("\u0001")
    if strict:
        for i, f in enumerate(schema.fields):
            bad = bad | ((F.trim(F.coalesce(f"_r{i}", F.lit(""))) != "") & F.col(f.name).isNull())
    return typed.filter(~bad).select(*[f.name for f in schema.fields])


def read_anomaly_labels(spark: SparkSession, path: str, whole_file: bool = False) -> DataFrame:
    """SRC-06: JSON objects {file: [timestamps]} -> rows (file, ts_str).
    One object per line by default (scales with the label volume); set
    ``whole_file`` for a single pretty-printed object per file."""
    raw = spark.read.text(path, wholetext=whole_file)
    m = F.from_json(F.col("value"), "map<string,array<string>>")
    return (raw.filter(F.trim("value") != "").select(F.explode(m).alias("file", "ts"))
            .select("file", F.explode("ts").alias("ts_str")))


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """SRC-07: full scan of a catalog table or a parquet path."""
    if "/" in name_or_path:
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


def read_heal_log(spark: SparkSession, path: str, schema: T.StructType = HEAL_LOG_SCHEMA) -> DataFrame:
    """SRC-08: tolerant JSONL — blank/bad lines dropped, NaN/Infinity -> NULL."""
    df = (spark.read.schema(schema).option("mode", "DROPMALFORMED")
          .option("allowNonNumericNumbers", True).json(path))
    c = df.select("*")

    def fix(x):
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)
    return c.withColumn("comparison", F.struct(fix(F.col("comparison.old_auc")).alias("old_auc"),
                                               fix(F.col("comparison.new_auc")).alias("new_auc"),
                                               fix(F.col("comparison.delta")).alias("delta")))


def stream_requests(spark: SparkSession, path: str, schema: T.StructType = TELEMETRY_SCHEMA,
                    fmt: str = "json", max_files_per_trigger: int | None = None) -> DataFrame:
    """SRC-09: continuous request records (file source; the schema is fixed)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


# --- sinks --------------------------------------------------------------------------------------------
def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by=None) -> None:
    """SNK-01: full rewrite (optionally partitioned, e.g. by date)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def append_rows(df: DataFrame, path: str, cols, fmt: str = "parquet") -> None:
    """SNK-02: append with a frozen column order."""
    df.select(*cols).write.mode("append").format(fmt).save(path)


def append_with_ids(spark: SparkSession, df: DataFrame, path: str, order, id_col: str = "id") -> None:
    """SNK-03: ids continue from COALESCE(MAX(id), 0) of the existing table.
    The new rows are numbered with the distributed row index (no single-task
    window)."""
    from faultline.operators import series
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    # an unreadable table is an error; only a missing one starts at 0
    start = spark.read.parquet(path).select(F.coalesce(F.max(id_col), F.lit(0))).first()[0] if there else 0
    idx = series.with_row_index(df, key=None, order=order, idx_col="_i")
    idx.withColumn(id_col, F.col("_i") + F.lit(start + 1)).drop("_i").write.mode("append").parquet(path)


def write_report_json(df: DataFrame, path: str) -> None:
    """SNK-04: summary metrics as one JSON document per row."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def append_audit_jsonl(df: DataFrame, path: str) -> None:
    """SNK-05: append-only run log (JSON lines)."""
    df.write.mode("append").json(path)


def write_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", trigger_once: bool = True):
    """SNK-06: streaming append sink with a checkpoint (exactly-once file sink)."""
    w = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()

"""Connectors and sinks: CSV / JSON / Parquet readers, event log, snapshots,
write-back, metrics and run manifests (A1, A6, A8, A9, A11, A12).

Writers append or write a new version; nothing overwrites a table that the
same plan reads.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEARNER_SCHEMA = T.StructType([
    T.StructField("student_id", T.StringType()), T.StructField("age", T.IntegerType()),
    T.StructField("gender", T.StringType()), T.StructField("learning_style", T.StringType()),
    T.StructField("attendance", T.DoubleType()), T.StructField("assignment_score", T.DoubleType()),
    T.StructField("quiz_score", T.DoubleType()), T.StructField("time_spent_hours", T.DoubleType()),
    T.StructField("attempts", T.IntegerType()), T.StructField("subject_strength", T.StringType()),
    T.StructField("subject_weakness", T.StringType()), T.StructField("previous_score", T.DoubleType()),
    T.StructField("internet_access", T.IntegerType()), T.StructField("extracurricular", T.IntegerType()),
    T.StructField("parental_support", T.StringType()), T.StructField("stress_level", T.StringType()),
    T.StructField("final_score", T.DoubleType()),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("event_type", T.StringType()), T.StructField("user_id", T.StringType()),
    T.StructField("item_id", T.StringType()), T.StructField("session_id", T.StringType()),
    T.StructField("timestamp_utc", T.StringType()), T.StructField("payload", T.StringType()),
    T.StructField("idempotency_key", T.StringType()),
])


def read_learners(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType = LEARNER_SCHEMA) -> DataFrame:
    """A1: learner table from CSV (header, explicit schema), JSON or Parquet."""
    r = spark.read.schema(schema)
    if fmt == "csv":
        return r.option("header", True).csv(path)
    if fmt == "json":
        return r.json(path)
    return spark.read.parquet(path)


CORRUPT = "_corrupt_record"


def read_checked(spark: SparkSession, path: str, fmt: str, schema: T.StructType, staging: str) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV (header) or JSON lines that fit ``schema``, and a quarantine of those that don't.

    The files are parsed once, into a staging table; the quarantine has ``file`` and ``record`` (the line as it stands).
    A record is bad if it cannot be parsed or a value has the wrong type; a missing value is NULL.
    """
    reader = (spark.read.schema(T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())]))
              .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT))
    rows = reader.option("header", True).csv(path) if fmt == "csv" else reader.json(path)
    rows.select("*", F.col("_metadata.file_path").alias("__file")).write.mode("overwrite").parquet(staging)
    staged = spark.read.parquet(staging)
    good = staged.filter(F.col(CORRUPT).isNull()).select(*schema.names)
    bad = staged.filter(F.col(CORRUPT).isNotNull()).select(F.col("__file").alias("file"), F.col(CORRUPT).alias("record"))
    return good, bad


def read_event_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Event log; timestamps parsed as UTC, unparseable -> NULL."""
    df = spark.read.parquet(path) if fmt == "parquet" else (
        spark.read.schema(EVENT_SCHEMA).option("header", True).csv(path) if fmt == "csv"
        else spark.read.schema(EVENT_SCHEMA).json(path))
    if dict(df.dtypes).get("timestamp_utc") == "string":
        df = df.withColumn("timestamp_utc", F.try_to_timestamp(F.col("timestamp_utc")))
    return df


def append_events(events: DataFrame, path: str, ts: str = "timestamp_utc") -> None:
    """Append to the event log, partitioned by event date (header written once by format)."""
    (events.withColumn("ingested_at_utc", F.current_timestamp())
     .withColumn("event_date", F.to_date(F.col(ts)))
     .write.mode("append").partitionBy("event_date").parquet(path))


def write_snapshot(snapshot: DataFrame, path: str, snapshot_date: str | None = None) -> str:
    """Snapshot sink, one partition per snapshot date."""
    d = snapshot_date or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d")
    snapshot.withColumn("snapshot_date", F.lit(d)).write.mode("append").partitionBy("snapshot_date").parquet(path)
    return d


def write_version(df: DataFrame, base: str, version: str) -> str:
    """Write-back as a new version folder (the input is never overwritten)."""
    out = f"{base.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(out)
    return out


def append_metrics(spark: SparkSession, path: str, run_id: str, rows: DataFrame, segment_col: str = "segment",
                   metrics: list[str] | None = None) -> None:
    """Long metrics table (run_id, segment, metric, value), appended."""
    metrics = metrics or [c for c, t in rows.dtypes if c != segment_col and t in ("double", "float", "int", "bigint")]
    st = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    seg = F.col(segment_col) if segment_col in rows.columns else F.lit("global")
    long = rows.select(seg.alias("segment"), *metrics).selectExpr(
        "segment", f"stack({len(metrics)}, {st}) AS (metric, value)")
    long.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)


def append_manifest(spark: SparkSession, path: str, version: str, artifacts: dict, metrics: dict, params: dict) -> None:
    """Append one run-manifest row."""
    row = [(version, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None),
            {k: str(v) for k, v in artifacts.items()}, {k: float(v) for k, v in metrics.items()},
            json.dumps(params, sort_keys=True, default=str))]
    schema = ("version string, created_at_utc timestamp_ntz, artifacts map<string,string>, "
              "metrics map<string,double>, params string")
    spark.createDataFrame(row, schema).write.mode("append").parquet(path)


def latest_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Latest manifest row by (version, created time) - ``max_by``, no sort."""
    m = spark.read.parquet(path)
    return m.agg(F.max_by(F.struct(*m.columns), F.struct("version", "created_at_utc")).alias("m")).select("m.*")

"""Readers for the driver's parquet tables and the three fixture views.

The fixture views (``learners``, ``topics``, ``feedback_events``) bind the
engine's data model to the TPC-H-like tables: they are plain DataFrame
plans, so every downstream operator scales with ``customer``, ``orders``,
``lineitem``, ``part`` and ``events``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")

# Fixed value: the feedback fixture maps the driver's event names onto the
# five event types of the feedback contract; unmapped names ("error") keep
# their own name and fail the contract.
EVENT_TYPE_MAP = {
    "view": "recommendation_shown",
    "click": "recommendation_clicked",
    "signup": "lesson_started",
    "purchase": "lesson_completed",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; column pruning and filters reach the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def learners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer, shaped like the learner table.

    ``lineitem`` is joined to ``orders`` and ``part`` once and aggregated to
    (customer, part type); the per-customer line totals are a roll-up of
    that small result, so the big join is not repeated.
    """
    orders = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus")
    line = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag", "l_quantity")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_type")
    cust = read_table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")

    o = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.sum(F.when(F.col("o_orderstatus") != "F", 1).otherwise(0)).alias("n_open"))

    lo = line.join(orders.select("o_orderkey", "o_custkey"),
                   F.col("l_orderkey") == F.col("o_orderkey"))
    typed = (lo.join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
             .groupBy("o_custkey", "p_type", F.col("p_partkey").isNotNull().alias("matched"))
             .agg(F.count(F.lit(1)).alias("n"),
                  F.sum(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).alias("n_kept"),
                  F.sum(F.col("l_quantity").cast("bigint")).alias("qty")))
    l = typed.groupBy("o_custkey").agg(
        F.sum("n").alias("n_lines"), F.sum("n_kept").alias("n_kept"),
        F.sum("qty").alias("qty"))
    t = typed.filter("matched").groupBy("o_custkey", "p_type").agg(F.sum("n").alias("n"))
    hi = Window.partitionBy("o_custkey").orderBy(F.col("n").desc(), F.col("p_type"))
    lo_w = Window.partitionBy("o_custkey").orderBy(F.col("n"), F.col("p_type").desc())
    r = t.select("o_custkey", "p_type",
                 F.row_number().over(hi).alias("hi"),
                 F.row_number().over(lo_w).alias("lo"))
    strength = r.filter("hi = 1").select(F.col("o_custkey").alias("s_cust"),
                                         F.col("p_type").alias("subject_strength"))
    weakness = r.filter("lo = 1").select(F.col("o_custkey").alias("w_cust"),
                                         F.col("p_type").alias("subject_weakness"))

    k = F.col("c_custkey")
    nat = F.col("c_nationkey")
    return (cust
            .join(o, k == o.o_custkey, "left")
            .join(l.withColumnRenamed("o_custkey", "l_cust"), k == F.col("l_cust"), "left")
            .join(strength, k == F.col("s_cust"), "left")
            .join(weakness, k == F.col("w_cust"), "left")
            .select(
                k.alias("student_id"),
                (F.lit(14) + nat % 11).cast("int").alias("age"),
                F.when(k % 3 == 0, "Female").when(k % 3 == 1, "Male").otherwise("Other").alias("gender"),
                F.col("c_mktsegment").alias("learning_style"),
                (F.col("n_open").cast("double") * 100 / F.col("n_orders")).alias("attendance"),
                (F.col("n_kept").cast("double") * 100 / F.col("n_lines")).alias("assignment_score"),
                ((F.col("c_acctbal") + 1000) / 110).alias("quiz_score"),
                F.least(F.greatest(F.col("n_lines").cast("double") / 10, F.lit(0.5)),
                        F.lit(15.0)).alias("time_spent_hours"),
                (F.lit(1) + F.col("n_orders") % 9).cast("int").alias("attempts"),
                (F.col("qty").cast("double") * 2 / F.col("n_lines")).alias("previous_score"),
                F.when(k % 5 == 0, 0).otherwise(1).alias("internet_access"),
                F.when(k % 5 < 2, 0).otherwise(1).alias("extracurricular"),
                F.when(k % 10 < 2, "Low").when(k % 10 < 7, "Medium").otherwise("High").alias("parental_support"),
                F.when(nat % 10 < 3, "Low").when(nat % 10 < 7, "Medium").otherwise("High").alias("stress_level"),
                F.col("subject_strength"), F.col("subject_weakness")))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic library ``(subject, topic, rnk, topic_idx)``: every type and brand of ``part``.

    The global ``topic_idx`` window runs over the distinct pairs only.
    """
    part = read_table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    ranked = part.withColumn(
        "rnk", F.row_number().over(Window.partitionBy("p_type").orderBy("p_brand")).cast("int"))
    return ranked.select(
        F.col("p_type").alias("subject"),
        F.concat(F.col("p_type"), F.lit(" "), F.col("p_brand")).alias("topic"),
        F.col("rnk"),
        (F.row_number().over(Window.orderBy("p_type", "rnk")) - 1).cast("int").alias("topic_idx"))


def n_topics(spark: SparkSession, sf_dir: str) -> int:
    """Size of the topic library."""
    return read_table(spark, sf_dir, "part").select("p_type", "p_brand").distinct().count()


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver ``events`` shaped as feedback events (one row per event)."""
    return shape_feedback(read_table(spark, sf_dir, "events"), n_topics(spark, sf_dir))


def shape_feedback(ev: DataFrame, topics_: int) -> DataFrame:
    """Projection from the driver's event rows to feedback events (batch or stream)
    over a library of ``topics_`` topics."""
    et = F.col("event_type")
    mapped = None
    for src, dst in EVENT_TYPE_MAP.items():
        mapped = (F.when(et == src, dst) if mapped is None else mapped.when(et == src, dst))
    mapped = mapped.otherwise(et)
    return ev.select(
        F.col("event_id"),
        F.col("ts").alias("timestamp_utc"),
        F.col("user_id"),
        mapped.alias("event_type"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % max(topics_, 1)).alias("topic_idx"),
        F.concat(F.col("user_id").cast("string"), F.lit(":"),
                 F.col("ts").cast("date").cast("string")).alias("session_id"),
        F.col("value"))


def event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The events table as a file stream (new parquet files are new events)."""
    schema = read_table(spark, sf_dir, "events").schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(os.path.join(sf_dir, "events*.parquet"))

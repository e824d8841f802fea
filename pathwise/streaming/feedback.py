"""Structured Streaming versions of the feedback path (G1-G12); keyed state with expiry (G4, G5, G7, G11) is in ``state``.

Sources are file streams over the event log; sinks are parquet tables in
the shared checkpoint folder.  Every micro-batch is written to a folder of its own
(``batch_id=<n>``) with overwrite, so a replayed batch replaces itself instead of adding
rows, and a table is never rewritten: the current state is each key's latest batch.
Every run uses its own checkpoint location; restarting on the same location resumes (G12).
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathwise.session import scratch_path
from pathwise.streaming.state import VECTOR_DIM, step


def new_run_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"stream/{name}/{uuid.uuid4().hex}")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def write_batch(batch: DataFrame, out: str, epoch: int, partition_col: str | None = None) -> None:
    """Write a micro-batch to its own folder; writing the same batch again replaces it."""
    w = batch.write.mode("overwrite")
    if partition_col is not None:
        w = w.partitionBy(partition_col)
    w.parquet(os.path.join(out, f"batch_id={epoch}"))


def key_hash(key: str) -> Column:
    return F.xxhash64(key)


def append_new(batch: DataFrame, out: str, epoch: int, key: str | None = None, partition_col: str | None = None) -> None:
    """Write the batch's rows whose ``key`` no other batch of the log holds.

    The log has a key index beside it (``<out>-keys``): the keys' 64-bit hashes, by ``partition_col`` (e.g. the event date, which
    is part of the idempotency key's material).  Only the index is probed, in the batch's partitions; rows whose hash stands
    there are looked up in the log itself, which tells a collision from a repeat.
    """
    spark = batch.sparkSession
    if key is None:
        write_batch(batch, out, epoch, partition_col)
        return
    on = F.col(partition_col) if partition_col else F.lit(0)
    batch = batch.dropDuplicates([key]).withColumn("__h", key_hash(key)).withColumn("__on", on).persist()
    columns = [c for c in batch.columns if c not in ("__h", "__on")]
    index, new = f"{out}-keys", batch
    if _exists(spark, index):
        values = [r[0] for r in batch.select("__on").distinct().collect()]  # partitions: days
        here = F.col("on").isin([v for v in values if v is not None]) | (F.col("on").isNull() if None in values else F.lit(False))
        seen = spark.read.parquet(index).filter((F.col("batch_id") != epoch) & here).select("on", "h").distinct()
        met = F.col("__h") == F.col("h")
        met = met & F.col("__on").eqNullSafe(F.col("on"))
        new = batch.join(seen, met, "left_anti")
        suspects = batch.join(seen, met, "left_semi").persist()
        if not suspects.isEmpty():
            log = spark.read.parquet(out).filter(F.col("batch_id") != epoch)
            log = log.select(F.col(key).alias("__key"), (F.col(partition_col) if partition_col else F.lit(0)).alias("on")).filter(here)
            same = (F.col(key) == F.col("__key")) & F.col("__on").eqNullSafe(F.col("on"))
            new = new.unionByName(suspects.join(log, same, "left_anti"))
        else:
            suspects.unpersist()
    write_batch(new.select(columns), out, epoch, partition_col)
    kept = spark.read.schema(new.select(columns).schema).parquet(os.path.join(out, f"batch_id={epoch}"))
    write_batch(kept.select(on.alias("on"), key_hash(key).alias("h")), index, epoch, "on")
    batch.unpersist()


IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
PARTITIONS = "spark.sql.shuffle.partitions"


def state_partitions(spark: SparkSession) -> int:
    """Partitions of a stream's state: two a core, or the session's number if that is less.

    Every micro-batch opens and commits each partition's store and writes each partition's files, however few rows it brings.
    """
    return min(int(spark.conf.get(PARTITIONS)), max(2, 2 * spark.sparkContext.defaultParallelism))


def _finish(spark: SparkSession, writer, run_dir: str, name: str = "checkpoint", idle: bool = True):
    """Run a query over all available input.

    ``idle`` allows batches without input, which let the watermark emit what it has passed.  State that expires by processing time
    (see ``state``) would ask for them without end, so its runs go without.
    """
    before, partitions = spark.conf.get(IDLE), spark.conf.get(PARTITIONS)
    spark.conf.set(IDLE, str(idle).lower())
    spark.conf.set(PARTITIONS, str(state_partitions(spark)))  # a checkpoint keeps the number it began with
    try:
        query = writer.option("checkpointLocation", os.path.join(run_dir, name)).trigger(availableNow=True).start()
    finally:
        spark.conf.set(IDLE, before)
        spark.conf.set(PARTITIONS, partitions)
    query.awaitTermination()
    return query


def run_append_log(spark: SparkSession, stream: DataFrame, run_dir: str, key: str | None = None,
                   partition_col: str | None = None, idle: bool = True) -> DataFrame:
    """Run an append stream over all available input into a log table (see :func:`append_new`)."""
    out = os.path.join(run_dir, "log")
    _finish(spark, stream.writeStream.outputMode("append").foreachBatch(
        lambda batch, epoch: append_new(batch, out, epoch, key, partition_col)), run_dir, idle=idle)
    if not _exists(spark, out):
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(out).drop("batch_id")


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of each key's latest batch."""
    last = updates.groupBy(*keys).agg(F.max("batch_id").alias("batch_id"))
    return updates.join(last, [*keys, "batch_id"]).drop("batch_id")


def run_updates(spark: SparkSession, stream: DataFrame, run_dir: str, keys: list[str], idle: bool = True) -> DataFrame:
    """Run an update-mode stream over all available input: every batch writes only the keys it changed.
    Returns the current rows of all keys."""
    out = os.path.join(run_dir, "updates")
    _finish(spark, stream.writeStream.outputMode("update").foreachBatch(
        lambda batch, epoch: write_batch(batch, out, epoch)), run_dir, idle=idle)
    if not _exists(spark, out):
        return spark.createDataFrame([], stream.schema)
    return latest(spark.read.parquet(out), keys)


# ------------------------------------------------------------------- G1
def idempotent_ingest(stream: DataFrame, key: str = "idempotency_key", ts: str = "event_ts",
                      delay: str = "2 hours") -> DataFrame:
    """G1's stateful step: drop events whose idempotency key was seen within the watermark.

    Events older than the watermark leave here; :func:`run_ingest` takes them by a side path.
    """
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def run_ingest(spark: SparkSession, stream: DataFrame, run_dir: str, key: str = "idempotency_key", ts: str = "event_ts",
               delay: str = "2 hours", partition_col: str | None = "event_date") -> DataFrame:
    """G1: every event once in the log, however late it comes.

    Two queries read the source.  The first drops repeats by keyed state that the watermark bounds and appends the rest; the
    second, on its own checkpoint, takes the events that were older than the first one's watermark (or have no time) around the
    state, straight to the keyed append, which leaves out what the log holds.  Its batches stand in the log under
    negative numbers.
    """
    out = os.path.join(run_dir, "log")
    done = _finish(spark, idempotent_ingest(stream, key, ts, delay).writeStream.outputMode("append").foreachBatch(
        lambda batch, epoch: append_new(batch, out, epoch, key, partition_col)), run_dir)
    marks = [p["eventTime"]["watermark"] for p in done.recentProgress if p["numInputRows"] and "watermark" in (p["eventTime"] or {})]

    def late(batch, epoch):
        if marks:
            limit = F.lit(max(marks)).cast("timestamp")
        else:  # restarted between the two: everything behind the newest event of the log
            newest = batch.sparkSession.read.parquet(out).agg(F.max(ts)).first()[0] if _exists(spark, out) else None
            limit = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        old = batch.filter(F.coalesce(F.col(ts).cast("timestamp") <= limit, F.lit(True))).persist()
        if not old.isEmpty():
            append_new(old, out, -1 - epoch, key, partition_col)
        old.unpersist()

    _finish(spark, stream.writeStream.outputMode("append").foreachBatch(late), run_dir, "late-checkpoint")
    if not _exists(spark, out):
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(out).drop("batch_id")


# ---------------------------------------------------------------- G2/G3
def online_user_features(stream: DataFrame, user: str = "user_id", ts: str = "event_ts",
                         tie: str = "event_id") -> DataFrame:
    """Per-user counters, ctr, completion rate, latest rating (last non-null),
    last event type and time - an order-free streaming aggregate."""
    et = F.col("event_type")
    order = F.struct(F.col(ts), F.col(tie))
    g = stream.groupBy(user).agg(
        F.count(F.lit(1)).alias("interactions"),
        F.count_if(et == "recommendation_clicked").alias("clicks"),
        F.count_if(et == "lesson_completed").alias("completions"),
        F.max_by(F.col("rating"), F.when(F.col("rating").isNotNull() & (et == "rating_submitted"), order)).alias("latest_rating"),
        F.max_by(et, order).alias("last_event_type"),
        F.max(ts).alias("last_event_ts"))
    n = F.greatest(F.col("interactions"), F.lit(1))
    return g.withColumn("ctr", F.col("clicks") / n).withColumn("completion_rate", F.col("completions") / n)


def online_item_features(stream: DataFrame, item: str = "item_id", ts: str = "event_ts") -> DataFrame:
    """Per-item views, clicks, item_ctr (clicks / max(views, 1)), last event time."""
    et = F.col("event_type")
    g = stream.filter(F.col(item).isNotNull()).groupBy(item).agg(
        F.count_if(et == "recommendation_shown").alias("views"),
        F.count_if(et == "recommendation_clicked").alias("clicks"),
        F.max(ts).alias("last_event_ts"))
    return g.withColumn("item_ctr", F.col("clicks") / F.greatest(F.col("views"), F.lit(1)))


# ------------------------------------------------------------------- G5
def online_user_vectors_batch(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """G5 batch twin: one shuffle by user, sort within partitions, then a
    streaming scan with per-user running state (rows are never gathered
    into one per-user frame, so a hot user costs time, not memory)."""
    parts = partitions or events.sparkSession.conf.get("spark.sql.shuffle.partitions")
    d = (events.select("user_id", "event_ts", "event_id", "item_vec", "reward")
         .repartition(int(parts), "user_id")
         .sortWithinPartitions("user_id", F.col("event_ts").asc_nulls_last(), "event_id"))

    def scan(batches):
        cur, v, n = None, None, 0
        out_u, out_v, out_n = [], [], []
        for pdf in batches:
            for u, iv, r in zip(pdf["user_id"], pdf["item_vec"], pdf["reward"]):
                if u != cur:
                    if cur is not None:
                        out_u.append(cur)
                        out_v.append(v.tolist())
                        out_n.append(n)
                    cur, v, n = u, np.zeros(VECTOR_DIM), 0
                v = step(v, np.asarray(iv, dtype=float), float(r))
                n += 1
            if len(out_u) > 10_000:
                yield pd.DataFrame({"user_id": out_u, "vector": out_v, "updates": out_n})
                out_u, out_v, out_n = [], [], []
        if cur is not None:
            out_u.append(cur)
            out_v.append(v.tolist())
            out_n.append(n)
        if out_u:
            yield pd.DataFrame({"user_id": out_u, "vector": out_v, "updates": out_n})
    return d.mapInPandas(scan, "user_id long, vector array<double>, updates long")


# ------------------------------------------------------------------- G8
def shown_events(recs: DataFrame, key: str = "student_id", item: str = "topic",
                 session: str | None = None) -> DataFrame:
    """One recommendation_shown event per recommended item (for the log)."""
    sid = F.col(session) if session else F.concat(F.col(key).cast("string"), F.lit(":rec"))
    return recs.select(F.lit("recommendation_shown").alias("event_type"), F.col(key).alias("user_id"),
                       F.col(item).alias("item_id"), sid.alias("session_id"), F.col("rnk").alias("position"))


# ------------------------------------------------------------------- G9
def rolling_rates(stream: DataFrame, ts: str = "event_ts", duration: str = "1 day",
                  slide: str | None = None, delay: str = "1 day") -> DataFrame:
    """CTR and completion per shown over tumbling (or sliding) event-time windows.

    On a stream a window's state goes once the watermark (``delay`` behind the latest event) has passed it.
    """
    stream = stream.withWatermark(ts, delay) if stream.isStreaming else stream
    w = F.window(ts, duration, slide) if slide else F.window(ts, duration)
    et = F.col("event_type")
    g = stream.groupBy(w.alias("w")).agg(
        F.count_if(et == "recommendation_shown").alias("shown"),
        F.count_if(et == "recommendation_clicked").alias("clicks"),
        F.count_if(et == "lesson_completed").alias("completed"))
    shown = F.greatest(F.col("shown"), F.lit(1))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "shown", "clicks", "completed", (F.col("clicks") / shown).alias("ctr"),
                    (F.col("completed") / shown).alias("completion_rate"))


# ------------------------------------------------------------------ G10
def sessions(events: DataFrame, user: str = "user_id", ts: str = "event_ts", gap: str = "30 minutes",
             delay: str = "1 day") -> DataFrame:
    """Event-time sessions per user (gap-based session windows).

    On a stream a session is emitted, and its state dropped, once the watermark has passed its end.
    """
    events = events.withWatermark(ts, delay) if events.isStreaming else events
    g = events.groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return g.select(user, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


# ------------------------------------------------------------------ G11
def live_features(features: DataFrame, as_of, ttl_seconds: int = 7200, ts: str = "last_event_ts") -> DataFrame:
    """Online features whose last event is within the TTL of ``as_of``."""
    return features.filter(F.col(ts) >= as_of - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))

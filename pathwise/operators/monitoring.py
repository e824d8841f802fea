"""Feature summaries, drift (PSI), online metrics and guardrails.

Percentiles use the floor-index rule ``sorted[floor(q (n-1))]`` computed
from a value histogram plus a running count (a window over distinct
values, partitioned by group), never from a single-partition sort of raw
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwise.operators.selection import one_row, quantiles


def unpivot(df: DataFrame, cols: list[str], name: str = "feature", value: str = "value",
            keep: list[str] | None = None) -> DataFrame:
    st = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.selectExpr(*(keep or []), f"stack({len(cols)}, {st}) AS ({name}, {value})")


def feature_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """F8: mean, population std, min, max and null rate per column (one groupBy)."""
    long = unpivot(df, cols)
    return long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg(F.when(F.col("value").isNull(), 1.0).otherwise(0.0)).alias("null_rate"))


def psi(reference: DataFrame, current: DataFrame, bins: int = 10) -> DataFrame:
    """population stability index per feature.

    Both inputs are long ``(feature, value)``.  Edges are the reference's
    equal-width edges ``min + i*(max-min)/bins`` (last edge = max; min == max
    widens to +-0.5); a value's bin is the count of inner edges <= value,
    values outside [min, max] are dropped; ratios are floored at 1e-6.
    """
    ref = reference.filter(F.col("value").isNotNull())
    cur = current.filter(F.col("value").isNotNull())
    rng = ref.groupBy("feature").agg(F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    rng = rng.select("feature",
                     F.when(F.col("__lo") == F.col("__hi"), F.col("__lo") - 0.5).otherwise(F.col("__lo")).alias("lo"),
                     F.when(F.col("__lo") == F.col("__hi"), F.col("__hi") + 0.5).otherwise(F.col("__hi")).alias("hi"))
    rng = rng.withColumn("edges", F.concat(
        F.transform(F.sequence(F.lit(0), F.lit(bins - 1)),
                    lambda i: F.col("lo") + i.cast("double") * ((F.col("hi") - F.col("lo")) / bins)),
        F.array(F.col("hi"))))

    def hist(df, tag):
        j = df.join(F.broadcast(rng), "feature")
        j = j.filter((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
        inner = F.slice(F.col("edges"), 2, bins - 1)
        b = F.aggregate(inner, F.lit(0), lambda acc, e: acc + F.when(F.col("value") >= e, 1).otherwise(0))
        return j.groupBy("feature", b.alias("bin")).agg(F.count(F.lit(1)).alias(tag))

    grid = rng.select("feature", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    h = (grid.join(hist(ref, "t_n"), ["feature", "bin"], "left")
         .join(hist(cur, "c_n"), ["feature", "bin"], "left").fillna(0, ["t_n", "c_n"]))
    w = Window.partitionBy("feature")
    h = (h.withColumn("t_r", F.greatest(F.col("t_n") / F.greatest(F.sum("t_n").over(w), F.lit(1)), F.lit(1e-6)))
         .withColumn("c_r", F.greatest(F.col("c_n") / F.greatest(F.sum("c_n").over(w), F.lit(1)), F.lit(1e-6))))
    return h.groupBy("feature").agg(
        F.sum((F.col("c_r") - F.col("t_r")) * F.log(F.col("c_r") / F.col("t_r"))).alias("psi"))


def floor_index_percentiles(df: DataFrame, value: str, qs: dict, group: list[str] | None = None) -> DataFrame:
    """F10 core: ``sorted[floor(q (n-1))]``, by exact selection, or per group from a value histogram.

    ``qs`` maps output name -> quantile.  Empty input yields no row (the
    caller decides the default).
    """
    if not group:
        found = quantiles(df, {value: list(qs.values())}, "floor")[value]
        row = one_row(df, dict(zip(qs, found)))
        return row if found[0] is not None else row.limit(0)
    h = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    wa = Window.partitionBy(*group)
    h = h.withColumn("__cum", F.sum("__c").over(w)).withColumn("__n", F.sum("__c").over(wa))
    aggs = []
    for name, q in qs.items():
        idx = F.floor(F.lit(q) * (F.col("__n") - 1))
        aggs.append(F.min(F.when(F.col("__cum") > idx, F.col(value))).alias(name))
    return h.groupBy(*group).agg(*aggs)


def online_metrics(requests: DataFrame, events: DataFrame, latency: str = "latency_ms",
                   cache_hit: str = "cache_hit") -> DataFrame:
    """latency p50/p95/p99 (floor index), cache hit rate, CTR and completion per shown."""
    p = floor_index_percentiles(requests, latency, {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95,
                                                    "latency_p99_ms": 0.99})
    r = requests.agg(F.count(F.lit(1)).alias("__req"), F.sum(F.col(cache_hit).cast("int")).alias("__hits"))
    et = F.col("event_type")
    e = events.agg(F.count_if(et == "recommendation_shown").alias("__shown"),
                   F.count_if(et == "recommendation_clicked").alias("__clicks"),
                   F.count_if(et == "lesson_completed").alias("__done"))
    shown = F.greatest(F.col("__shown"), F.lit(1))
    return (p.crossJoin(r).crossJoin(e).select(
        "latency_p50_ms", "latency_p95_ms", "latency_p99_ms",
        (F.coalesce(F.col("__hits"), F.lit(0)) / F.greatest(F.col("__req"), F.lit(1))).alias("cache_hit_rate"),
        (F.col("__clicks") / shown).alias("ctr"),
        (F.col("__done") / shown).alias("completion_at_k_proxy")))


def guardrails(obs: DataFrame, bucket: str, latency: str = "latency_ms", success: str = "success",
               drop: str = "low_engagement_drop") -> DataFrame:
    """failure rate, p95 latency (floor index) and drop rate per bucket."""
    p = floor_index_percentiles(obs, latency, {"latency_p95_ms": 0.95}, [bucket])
    c = obs.groupBy(bucket).agg(
        F.count(F.lit(1)).alias("__n"),
        F.count_if(~F.col(success)).alias("__fail"),
        F.count_if(F.col(drop)).alias("__drop"))
    n = F.greatest(F.col("__n"), F.lit(1))
    return c.join(p, bucket, "left").select(
        bucket, (F.col("__fail") / n).alias("failure_rate"),
        F.coalesce(F.col("latency_p95_ms"), F.lit(0.0)).alias("latency_p95_ms"),
        (F.col("__drop") / n).alias("low_engagement_drop_rate"))

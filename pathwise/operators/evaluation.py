"""Offline evaluation: regression metrics, ranking metrics, reports.

Per-request ranking metrics are computed on long tables ``(key, topic,
rnk)`` with a running-hits window partitioned by request; reports are
grouped aggregates (``rollup`` gives global + segment rows in one pass).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pathwise.functions.expressions import first_token
from pathwise.operators.selection import one_row, quantiles


# ---------------------------------------------------------------- F12-F15
def regression_metrics(df: DataFrame, y: str = "y", p: str = "p", group: list[str] | None = None) -> DataFrame:
    """F12 (+F14 with ``group``, +F15 within_10): RMSE, MAE, R2, MAPE %.

    R2 uses the group mean from a first aggregate joined back (two passes,
    no cancellation); MAPE's denominator is floored at 1e-6.
    """
    group = group or []
    d = df.select(*group, F.col(y).cast("double").alias("__y"), F.col(p).cast("double").alias("__p"))
    mu = d.groupBy(*group).agg(F.avg("__y").alias("__mu"))
    j = d.join(F.broadcast(mu), group, "inner") if group else d.crossJoin(F.broadcast(mu))
    err = F.col("__y") - F.col("__p")
    g = j.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err * err).alias("__mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.sum(err * err).alias("__ssr"),
        F.sum((F.col("__y") - F.col("__mu")) * (F.col("__y") - F.col("__mu"))).alias("__sst"),
        (F.avg(F.abs(err / F.greatest(F.abs(F.col("__y")), F.lit(1e-6)))) * 100.0).alias("mape"),
        F.avg(F.when(F.abs(err) <= 10, 1.0).otherwise(0.0)).alias("within_10"))
    r2 = F.when(F.col("__sst") == 0, F.when(F.col("__ssr") == 0, 1.0).otherwise(0.0)) \
        .otherwise(F.lit(1.0) - F.col("__ssr") / F.col("__sst"))
    return g.select(*group, F.col("n").cast("bigint").alias("n"), F.sqrt("__mse").alias("rmse"), "mae",
                    r2.alias("r2"), "mape", "within_10")


def calibration_error(df: DataFrame, y: str = "y", p: str = "p", bins: int = 10,
                      group: list[str] | None = None) -> DataFrame:
    """mean |mean(y) - mean(p)| over quantile bins of y.

    Edges are the linear quantiles of y at i/bins; duplicate edges are
    dropped; bins are right-closed with the lowest edge included.  (For a
    group with fewer rows than ``bins`` the edges stay the i/bins quantiles.)
    """
    group = group or []
    d = df.select(*group, F.col(y).cast("double").alias("__y"), F.col(p).cast("double").alias("__p"))
    steps = [i / bins for i in range(bins + 1)]
    if group:
        e = d.groupBy(*group).agg(F.array_distinct(F.percentile("__y", F.array(*[F.lit(q) for q in steps]))).alias("__edges"))
    else:
        e = (one_row(d, {f"e{i}": v for i, v in enumerate(quantiles(d, {"__y": steps})["__y"])})
             .select(F.array_distinct(F.array(*[F.col(f"e{i}") for i in range(bins + 1)])).alias("__edges")))
    j = d.join(F.broadcast(e), group, "inner") if group else d.crossJoin(F.broadcast(e))
    inner = F.slice(F.col("__edges"), 2, bins)
    j = j.withColumn("__bin", F.size(F.filter(inner, lambda v: v < F.col("__y"))))
    per_bin = j.groupBy(*group, "__bin").agg(F.avg("__y").alias("__my"), F.avg("__p").alias("__mp"))
    return per_bin.groupBy(*group).agg(F.avg(F.abs(F.col("__my") - F.col("__mp"))).alias("calibration_error"))


def conformal_interval(calib: DataFrame, target: DataFrame, y: str = "y", p: str = "p",
                       alpha: float = 0.1) -> DataFrame:
    """q = linear (1-alpha) quantile of |y-p| on the calibration rows;
    interval p +- q on the target rows, plus the width 2q."""
    error = calib.select(F.abs(F.col(y) - F.col(p)).alias("__e"))
    q = one_row(calib, {"__q": quantiles(error, {"__e": [1.0 - alpha]})["__e"][0]})
    return (target.crossJoin(F.broadcast(q))
            .withColumn("lower", F.col(p) - F.col("__q")).withColumn("upper", F.col(p) + F.col("__q"))
            .withColumn("width", F.col("upper") - F.col("lower")).drop("__q"))


# ------------------------------------------------------------ F16-F21
def ranking_metrics(recs: DataFrame, relevant: DataFrame, key: str, k: int, rnk: str = "rnk",
                    item: str = "topic", novelty_token: str = "Basics") -> DataFrame:
    """F16-F20 per request: hit, precision, recall, NDCG, MAP (over hits found),
    diversity (distinct prefixes / length, 0 when length <= 1) and novelty.

    ``recs`` = (key, item, rnk 1..), ``relevant`` = (key, item).  Requests
    with no recommendation still get a row when they have relevant items.
    """
    top = recs.filter(F.col(rnk) <= k).select(key, item, rnk)
    rel = relevant.select(key, item).distinct()
    nrel = rel.groupBy(key).agg(F.count(F.lit(1)).alias("n_relevant"))
    j = top.join(rel.withColumn("__hit", F.lit(1)), [key, item], "left").fillna(0, ["__hit"])
    w = Window.partitionBy(key).orderBy(rnk).rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("__cum", F.sum("__hit").over(w))
    per = j.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_recs"),
        F.sum("__hit").alias("hits"),
        F.sum(F.col("__hit") / F.log2(F.col(rnk) + 1.0)).alias("__dcg"),
        F.sum(F.when(F.col("__hit") == 1, F.col("__cum") / F.col(rnk))).alias("__ap"),
        F.count_distinct(first_token(item)).alias("__pref"),
        F.sum(F.when(F.col(item).contains(novelty_token), 0.0).otherwise(1.0)).alias("__novel"))
    per = per.join(nrel, key, "full_outer").fillna(0, ["n_recs", "hits", "n_relevant", "__pref"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.lit(k), F.col("n_relevant")), F.lit(1))),
                        F.lit(0.0), lambda a, i: a + F.lit(1.0) / F.log2(i + 1.0))
    ideal = F.when(F.least(F.lit(k), F.col("n_relevant")) > 0, ideal).otherwise(F.lit(0.0))
    return per.select(
        key,
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit"),
        F.when(F.col("n_recs") > 0, F.col("hits") / F.col("n_recs")).otherwise(0.0).alias("precision"),
        F.when(F.col("n_relevant") > 0, F.col("hits") / F.col("n_relevant")).otherwise(0.0).alias("recall"),
        F.when(ideal > 0, F.coalesce(F.col("__dcg"), F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg"),
        F.when(F.col("hits") > 0, F.col("__ap") / F.col("hits")).otherwise(0.0).alias("map"),
        F.when(F.col("n_recs") <= 1, 0.0).otherwise(F.col("__pref") / F.col("n_recs")).alias("diversity"),
        (F.coalesce(F.col("__novel"), F.lit(0.0)) / F.greatest(F.col("n_recs"), F.lit(1))).alias("novelty"))


METRICS = ["hit", "precision", "recall", "ndcg", "map", "diversity", "novelty"]


def coverage(recs: DataFrame, catalogue: DataFrame, k: int, item: str = "topic", rnk: str = "rnk") -> DataFrame:
    """distinct recommended items / catalogue size (one row)."""
    rec = recs.filter(F.col(rnk) <= k).agg(F.count_distinct(item).alias("__r"))
    cat = catalogue.agg(F.count_distinct(item).alias("__c"))
    return rec.crossJoin(cat).select((F.col("__r") / F.greatest(F.col("__c"), F.lit(1))).alias("coverage"))


def evaluation_report(per_request: DataFrame, segments: DataFrame, key: str) -> DataFrame:
    """mean of each metric globally (segment 'global') and per segment, one pass."""
    j = per_request.join(segments.select(key, "segment"), key, "left")
    r = j.rollup("segment").agg(F.count(F.lit(1)).alias("samples"), *[F.avg(m).alias(m) for m in METRICS])
    return r.withColumn("segment", F.coalesce(F.col("segment"), F.lit("global"))) \
        .withColumn("samples", F.col("samples").cast("bigint"))


def difficulty_relevance(learners: DataFrame, topics: DataFrame, key: str = "student_id",
                         subject_col: str = "subject_weakness", quiz_col: str = "quiz_score") -> DataFrame:
    """ground truth A - <50 first 3, <70 the 2nd-4th (all if <=3), else the last 3.
    Unknown subject: the first 3 topics of every subject."""
    n = topics.groupBy("subject").agg(F.max("rnk").alias("__n"))
    t = topics.join(n, "subject")
    l = learners.select(key, subject_col, quiz_col)
    j = l.join(F.broadcast(t), l[subject_col] == t["subject"])
    q, r, m = F.col(quiz_col), F.col("rnk"), F.col("__n")
    keep = (F.when(q < 50, r <= 3)
            .when(q < 70, F.when(m > 3, (r >= 2) & (r <= 4)).otherwise(F.lit(True)))
            .otherwise(F.when(m >= 3, r > m - 3).otherwise(F.lit(True))))
    known = j.filter(keep).select(key, "topic")
    unknown = (l.join(F.broadcast(t.select("subject").distinct()), l[subject_col] == F.col("subject"), "left_anti")
               .crossJoin(F.broadcast(topics.filter(F.col("rnk") <= 3).select("topic"))).select(key, "topic"))
    return known.unionByName(unknown)


def subject_relevance(learners: DataFrame, topics: DataFrame, key: str = "student_id",
                      subject_col: str = "subject_weakness") -> DataFrame:
    """ground truth B - every topic of the weak subject."""
    l = learners.select(key, subject_col)
    return l.join(F.broadcast(topics), l[subject_col] == topics["subject"]).select(key, "topic")


def evaluate_methods(recs: DataFrame, relevant: DataFrame, key: str, ks=(3, 5, 10),
                     methods: list[str] | None = None, item: str = "topic") -> DataFrame:
    """mean metrics per (method, k); ``recs`` carry a ``method`` column.

    The ranked lists are matched with the relevant items once; each match counts for every k that
    reaches its rank.  Pass ``methods`` if they are known, which saves a pass over ``recs``.
    """
    names = methods if methods is not None else [r[0] for r in recs.select("method").distinct().collect()]
    each_k = F.explode(F.array(*[F.lit(k) for k in ks]))
    rel = relevant.select(key, item).distinct()
    hits = (recs.filter(F.col("rnk") <= max(ks)).select("method", key, item, "rnk")
            .join(rel.withColumn("__hit", F.lit(1)), [key, item], "left"))
    per = (hits.select("method", key, "rnk", F.coalesce("__hit", F.lit(0)).alias("__hit"), each_k.alias("k"))
           .filter(F.col("rnk") <= F.col("k")).groupBy("method", key, "k")
           .agg(F.count(F.lit(1)).alias("n_recs"), F.sum("__hit").alias("hits"),
                F.sum(F.col("__hit") / F.log2(F.col("rnk") + 1.0)).alias("dcg")))
    asked = (rel.groupBy(key).agg(F.count(F.lit(1)).alias("n_relevant"))
             .withColumn("method", F.explode(F.array(*[F.lit(m) for m in names]))).withColumn("k", each_k))
    per = per.join(asked, ["method", key, "k"], "full_outer").fillna(0, ["n_recs", "hits", "n_relevant"])
    depth = F.least(F.col("k"), F.col("n_relevant").cast("int"))
    ideal = F.when(depth > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), F.lit(0.0),
                                          lambda a, i: a + F.lit(1.0) / F.log2(i + 1.0))).otherwise(0.0)
    share = lambda n: F.when(F.col(n) > 0, F.col("hits") / F.col(n)).otherwise(0.0)
    per = per.withColumn("ideal", ideal)
    return per.groupBy("method", "k").agg(
        F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)).alias("hit"), F.avg(share("n_recs")).alias("precision"),
        F.avg(share("n_relevant")).alias("recall"),
        F.avg(F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)).alias("ndcg"))


def _method_metrics(recs: DataFrame, relevant: DataFrame, key: str, k: int) -> DataFrame:
    r = recs.withColumn("__rk", F.struct(F.col("method"), F.col(key)))
    methods = recs.select("method").distinct()
    rel = relevant.join(F.broadcast(methods)).withColumn("__rk", F.struct(F.col("method"), F.col(key)))
    m = ranking_metrics(r, rel, "__rk", k)
    return m.select(F.col("__rk.method").alias("method"), F.col("__rk").getField(key).alias(key),
                    "hit", "precision", "recall", "ndcg", "map")


def comparison_matrix(per_method: DataFrame, methods: list[str], metrics=("hit", "precision", "recall", "ndcg")) -> DataFrame:
    """(k, metric) rows x one column per method."""
    st = ", ".join(f"'{m}', `{m}`" for m in metrics)
    long = per_method.selectExpr("method", "k", f"stack({len(metrics)}, {st}) AS (metric, value)")
    return long.groupBy("k", "metric").pivot("method", methods).agg(F.first("value"))


def best_method(per_method: DataFrame, metrics=("hit", "precision", "recall", "ndcg")) -> DataFrame:
    """best method per (k, metric); ties go to the smallest method name."""
    st = ", ".join(f"'{m}', `{m}`" for m in metrics)
    long = per_method.selectExpr("method", "k", f"stack({len(metrics)}, {st}) AS (metric, value)")
    w = Window.partitionBy("k", "metric").orderBy(F.col("value").desc(), F.col("method"))
    return (long.withColumn("__r", F.row_number().over(w)).filter("__r = 1")
            .select("k", "metric", F.col("method").alias("best_method"), F.col("value").alias("best_value")))


def cv_summary(per_fold: DataFrame, metrics: list[str], group: list[str] | None = None) -> DataFrame:
    """mean and sample std of each metric over folds."""
    group = group or []
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"cv_{m}_mean"), F.stddev_samp(m).alias(f"cv_{m}_std")]
    return per_fold.groupBy(*group).agg(F.count(F.lit(1)).alias("folds"), *aggs)


def ab_lift(per_request: DataFrame, variants: DataFrame, key: str, metric: str = "hit") -> DataFrame:
    """metric mean per variant and lift = B - A (one row)."""
    j = per_request.join(variants.select(key, "variant"), key)
    g = j.groupBy().pivot("variant", ["A", "B"]).agg(F.avg(metric))
    return g.select(F.col("A").alias("variant_a"), F.col("B").alias("variant_b"),
                    (F.col("B") - F.col("A")).alias("lift"))


def metric_delta(current: DataFrame, previous: DataFrame, keys=("model", "metric")) -> DataFrame:
    """current - previous value per (model, metric)."""
    p = previous.withColumnRenamed("value", "previous_value")
    return (current.join(p, list(keys), "full_outer")
            .withColumn("delta", F.col("value") - F.col("previous_value")))


def tuning_objective(grid_metrics: DataFrame) -> DataFrame:
    """F32: .30 hit + .20 ndcg + .15 map + .15 coverage + .15 cold + .05 struggling,
    ranked by (hit, cold_start_hit, ndcg, map) descending, then grid id.  The
    grid is small (one row per parameter setting), so the ranking window is
    over a dictionary-sized input."""
    c = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    s = (F.lit(0.30) * c("hit") + F.lit(0.20) * c("ndcg") + F.lit(0.15) * c("map")
         + F.lit(0.15) * c("coverage") + F.lit(0.15) * c("cold_start_hit") + F.lit(0.05) * c("struggling_hit"))
    # metric means equal to 12 decimals are ties (same lists averaged in another order)
    t = lambda n: F.floor(c(n) * 1e12 + 0.5)
    w = Window.orderBy(t("hit").desc(), t("cold_start_hit").desc(), t("ndcg").desc(), t("map").desc(),
                       F.col("grid_id"))
    return grid_metrics.withColumn("objective", s).withColumn("grid_rank", F.row_number().over(w).cast("int"))


def best_model(comparison: DataFrame) -> DataFrame:
    """model with the smallest RMSE (ties -> model name)."""
    return comparison.agg(F.min_by("model", F.struct("rmse", "model")).alias("best_model"),
                          F.min("rmse").alias("best_rmse"))


def blend_mean(df: DataFrame, cols: list[str], out: str = "blend") -> DataFrame:
    """row mean of several model predictions."""
    s = None
    for c in cols:
        s = F.col(c) if s is None else s + F.col(c)
    return df.withColumn(out, s / float(len(cols)))

"""Registered queries: regression and ranking evaluation, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathwise.functions.expressions import scaled
from pathwise.operators import candidates as D
from pathwise.operators import evaluation as EV
from pathwise.operators import events as EVT
from pathwise.operators import scoring as S
from pathwise.plans import common as C
from pathwise.plans.catalog import register
from pathwise.plans.q_candidates import PRIOR_SQL, SEGMENTS, _seg_ctes
from pathwise.plans.q_scoring import FINAL
from pathwise.plans.sqlparts import FEAT_CTE, clip as sc, scaled as sq

LT = ("learners", "topics")
L = ("learners",)
C9 = sc("0.45 * quiz_score + 0.35 * consistency_score + 0.2 * engagement_score", 0, 100)
C10 = "quiz_score * 0.4 + attendance * 0.3 + assignment_score * 0.3"
YP_SQL = f"""{FEAT_CTE.strip()},
yp AS (SELECT student_id, quiz_score, {FINAL} AS y, {C9} AS p, {C10} AS p2,
              ('0x' || substr(md5('42:' || CAST(student_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 80 AS is_train,
              CASE WHEN quiz_score > -1 AND quiz_score <= 55 THEN 'struggling' WHEN quiz_score > 55 AND quiz_score <= 75 THEN 'mid'
                   WHEN quiz_score > 75 AND quiz_score <= 101 THEN 'fast' END AS segment FROM feat)"""


def _yp(spark, sf):
    f = C.features(spark, sf)
    f = EVT.hash_split(f, "student_id")
    return f.select("student_id", "quiz_score", F.col("final_score").alias("y"),
                    S.base_score_proxy("quiz_score", "consistency_score", "engagement_score").alias("p"),
                    S.no_model_prediction("quiz_score", "attendance", "assignment_score").alias("p2"),
                    "is_train", S.quiz_segment("quiz_score").alias("segment"))


def _reg_sql(where: str = "", group: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    part = f"PARTITION BY {group}" if group else ""
    return f"""m AS (SELECT *, AVG(y) OVER ({part}) AS mu FROM yp {where})
SELECT {g}CAST(COUNT(*) AS BIGINT) AS n, {sq('SQRT(AVG((y - p) * (y - p)))')} AS rmse, {sq('AVG(ABS(y - p))')} AS mae,
  {sq('CASE WHEN SUM((y - mu) * (y - mu)) = 0 THEN CASE WHEN SUM((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 - SUM((y - p) * (y - p)) / SUM((y - mu) * (y - mu)) END')} AS r2,
  {sq('AVG(ABS((y - p) / GREATEST(ABS(y), 1e-6))) * 100.0')} AS mape,
  {sq('AVG(CASE WHEN ABS(y - p) <= 10 THEN 1.0 ELSE 0.0 END)')} AS within_10
FROM m {gb}"""


def _scale_reg(df, group=()):
    return df.select(*group, "n", *[scaled(c).alias(c) for c in ["rmse", "mae", "r2", "mape", "within_10"]])


@register("f12_f15_regression_metrics", f"WITH {YP_SQL},\n{_reg_sql()}", L)
def f12(spark, sf):
    return _scale_reg(EV.regression_metrics(_yp(spark, sf)))


@register("f14_segment_metrics", f"WITH {YP_SQL},\n{_reg_sql(group='segment')}", L)
def f14(spark, sf):
    return _scale_reg(EV.regression_metrics(_yp(spark, sf), group=["segment"]), ["segment"])


@register("f13_calibration_error", f"""WITH {YP_SQL},
e AS (SELECT quantile_cont(y, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM yp),
b AS (SELECT y, p, len(list_filter((SELECT list_sort(list_distinct(q)) FROM e)[2:], lambda v: v < y)) AS bin FROM yp),
pb AS (SELECT bin, AVG(y) AS my, AVG(p) AS mp FROM b GROUP BY bin)
SELECT {sq('AVG(ABS(my - mp))')} AS calibration_error FROM pb""", L)
def f13(spark, sf):
    return EV.calibration_error(_yp(spark, sf)).select(scaled("calibration_error").alias("calibration_error"))


@register("f30_conformal_interval", f"""WITH {YP_SQL},
q AS (SELECT quantile_cont(ABS(y - p), 0.9) AS q FROM yp WHERE is_train)
SELECT student_id, {sq('p - q')} AS lower, {sq('p + q')} AS upper, {sq('(p + q) - (p - q)')} AS width
FROM yp, q WHERE NOT is_train""", L)
def f30(spark, sf):
    yp = _yp(spark, sf)
    r = EV.conformal_interval(yp.filter("is_train"), yp.filter("NOT is_train"))
    return r.select("student_id", scaled("lower").alias("lower"), scaled("upper").alias("upper"),
                    scaled("width").alias("width"))


@register("f31_metric_delta", f"""WITH {YP_SQL},
cur AS (SELECT 'proxy' AS model, UNNEST(['rmse', 'mae']) AS metric,
               UNNEST([SQRT(AVG((y - p) * (y - p))), AVG(ABS(y - p))]) AS value FROM yp),
prev AS (SELECT 'proxy' AS model, UNNEST(['rmse', 'mae']) AS metric,
                UNNEST([SQRT(AVG((y - p2) * (y - p2))), AVG(ABS(y - p2))]) AS previous_value FROM yp)
SELECT model, metric, {sq('value')} AS value, {sq('previous_value')} AS previous_value, {sq('value - previous_value')} AS delta
FROM cur FULL OUTER JOIN prev USING (model, metric)""", L)
def f31(spark, sf):
    yp = _yp(spark, sf)

    def long(df, pcol, name):
        m = EV.regression_metrics(df.withColumn("p", F.col(pcol)))
        return m.selectExpr("'proxy' AS model", f"stack(2, 'rmse', rmse, 'mae', mae) AS (metric, {name})")
    cur = long(yp, "p", "value")
    prev = long(yp, "p2", "value")
    d = EV.metric_delta(cur, prev)
    return d.select("model", "metric", scaled("value").alias("value"), scaled("previous_value").alias("previous_value"),
                    scaled("delta").alias("delta"))


@register("f33_f34_model_comparison", f"""WITH {YP_SQL},
b AS (SELECT y, p, p2, (p + p2) / 2.0 AS p3 FROM yp),
cmp AS (SELECT 'proxy' AS model, SQRT(AVG((y - p) * (y - p))) AS rmse FROM b
        UNION ALL SELECT 'fallback', SQRT(AVG((y - p2) * (y - p2))) FROM b
        UNION ALL SELECT 'blend', SQRT(AVG((y - p3) * (y - p3))) FROM b)
SELECT arg_min(model, (rmse, model)) AS best_model, {sq('MIN(rmse)')} AS best_rmse FROM cmp""", L)
def f33(spark, sf):
    yp = EV.blend_mean(_yp(spark, sf), ["p", "p2"], "p3")
    parts = []
    for name, col in [("proxy", "p"), ("fallback", "p2"), ("blend", "p3")]:
        parts.append(EV.regression_metrics(yp.withColumn("p", F.col(col)).select("y", "p")).select(
            F.lit(name).alias("model"), "rmse"))
    cmp = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return EV.best_model(cmp).select("best_model", scaled("best_rmse").alias("best_rmse"))


# ------------------------------------------------------------- ranking
REL_SQL = """rel AS (
  SELECT l.student_id, t.topic FROM learners l JOIN topics t ON t.subject = l.subject_weakness
  JOIN (SELECT subject, MAX(rnk) AS n FROM topics GROUP BY subject) m ON m.subject = t.subject
  WHERE (l.quiz_score < 50 AND t.rnk <= 3)
     OR (l.quiz_score >= 50 AND l.quiz_score < 70 AND (m.n <= 3 OR t.rnk BETWEEN 2 AND 4))
     OR (l.quiz_score >= 70 AND (m.n < 3 OR t.rnk > m.n - 3))
  UNION ALL
  SELECT l.student_id, t.topic FROM learners l JOIN topics t ON t.rnk <= 3
  WHERE l.subject_weakness IS NULL OR l.subject_weakness NOT IN (SELECT subject FROM topics))"""

RECS_SQL = f"""{PRIOR_SQL[:-1]}),
{_seg_ctes()},
cold AS (
  SELECT student_id, topic, ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY prio, pos) AS rnk FROM (
    SELECT * FROM (SELECT student_id, topic, prio, pos, ROW_NUMBER() OVER (PARTITION BY student_id, topic ORDER BY prio, pos) AS f FROM (
      SELECT student_id, topic, prio, pos FROM prior WHERE pos <= 5
      UNION ALL SELECT l.student_id, t.topic, 1, t.topic_idx + 1 FROM learners l JOIN topics t ON t.topic_idx < 10) u) d
    WHERE f = 1) z QUALIFY rnk <= 5),
recs AS (SELECT 'content' AS method, student_id, topic, pos AS rnk FROM prior WHERE pos <= 10
         UNION ALL SELECT 'segment', student_id, topic, pos FROM lb JOIN pool USING (band) WHERE pos <= 10
         UNION ALL SELECT 'cold_start', student_id, topic, rnk FROM cold)"""


def metrics_sql(k: int, methods_filter: str = "") -> str:
    """Per (method, student) ranking metrics at k (oracle form)."""
    return f"""top{k} AS (SELECT * FROM recs WHERE rnk <= {k} {methods_filter}),
j{k} AS (SELECT t.*, CASE WHEN EXISTS (SELECT 1 FROM rel r WHERE r.student_id = t.student_id AND r.topic = t.topic) THEN 1 ELSE 0 END AS hit
        FROM top{k} t),
c{k} AS (SELECT *, SUM(hit) OVER (PARTITION BY method, student_id ORDER BY rnk ROWS UNBOUNDED PRECEDING) AS cum FROM j{k}),
nr AS (SELECT student_id, COUNT(*) AS n_relevant FROM (SELECT DISTINCT * FROM rel) d GROUP BY student_id),
per{k} AS (SELECT method, student_id, COUNT(*) AS n_recs, SUM(hit) AS hits, SUM(hit / log2(rnk + 1.0)) AS dcg,
             SUM(CASE WHEN hit = 1 THEN cum / rnk END) AS ap, COUNT(DISTINCT split_part(topic, ' ', 1)) AS pref,
             SUM(CASE WHEN topic LIKE '%Basics%' THEN 0.0 ELSE 1.0 END) AS novel
           FROM c{k} GROUP BY method, student_id),
all{k} AS (SELECT m.method, nr.student_id FROM nr, (SELECT DISTINCT method FROM top{k}) m
           UNION SELECT method, student_id FROM per{k}),
pm{k} AS (SELECT a.method, a.student_id, COALESCE(p.n_recs, 0) AS n_recs, COALESCE(p.hits, 0) AS hits,
            COALESCE(nr.n_relevant, 0) AS n_relevant, p.dcg, p.ap, COALESCE(p.pref, 0) AS pref, p.novel,
            CASE WHEN LEAST({k}, COALESCE(nr.n_relevant, 0)) > 0
                 THEN list_sum(list_transform(range(1, LEAST({k}, nr.n_relevant) + 1), lambda i: 1.0 / log2(i + 1.0))) ELSE 0.0 END AS ideal
          FROM all{k} a LEFT JOIN per{k} p ON p.method = a.method AND p.student_id = a.student_id
          LEFT JOIN nr ON nr.student_id = a.student_id),
rm{k} AS (SELECT method, student_id,
            CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END AS hit,
            CASE WHEN n_recs > 0 THEN hits / n_recs ELSE 0.0 END AS precision,
            CASE WHEN n_relevant > 0 THEN hits / n_relevant ELSE 0.0 END AS recall,
            CASE WHEN ideal > 0 THEN COALESCE(dcg, 0.0) / ideal ELSE 0.0 END AS ndcg,
            CASE WHEN hits > 0 THEN ap / hits ELSE 0.0 END AS map,
            CASE WHEN n_recs <= 1 THEN 0.0 ELSE pref / n_recs END AS diversity,
            COALESCE(novel, 0.0) / GREATEST(n_recs, 1) AS novelty
          FROM pm{k})"""


def _recs(spark, sf):
    l, t = C.learners(spark, sf), C.topics(spark, sf)
    c = D.content_candidates(l, t, 10).select("student_id", "topic", "rnk", F.lit("content").alias("method"))
    s = D.segment_popular(l, t, SEGMENTS, 10).select("student_id", "topic", "rnk", F.lit("segment").alias("method"))
    cs = D.cold_start(l, t, 5).select("student_id", "topic", "rnk", F.lit("cold_start").alias("method"))
    return c.unionByName(s).unionByName(cs)


def _rel(spark, sf):
    return EV.difficulty_relevance(C.learners(spark, sf), C.topics(spark, sf))


def _scale_rank(df, keys):
    return df.select(*keys, "hit", "precision", "recall", scaled("ndcg").alias("ndcg"), scaled("map").alias("map"),
                     scaled("diversity").alias("diversity"), scaled("novelty").alias("novelty"))


@register("f16_f20_ranking_metrics", f"""WITH {RECS_SQL}, {REL_SQL}, {metrics_sql(5, "AND method = 'content'")}
SELECT student_id, hit, precision, recall, {sq('ndcg')} AS ndcg, {sq('map')} AS map,
       {sq('diversity')} AS diversity, {sq('novelty')} AS novelty FROM rm5""", LT)
def f16(spark, sf):
    recs = _recs(spark, sf).filter(F.col("method") == "content")
    m = EV.ranking_metrics(recs, _rel(spark, sf), "student_id", 5)
    return _scale_rank(m, ["student_id"])


@register("f21_coverage", f"""WITH {RECS_SQL}
SELECT method, COUNT(DISTINCT topic) / GREATEST((SELECT COUNT(DISTINCT topic) FROM topics), 1) AS coverage
FROM recs WHERE rnk <= 5 GROUP BY method""", LT)
def f21(spark, sf):
    recs = _recs(spark, sf)
    t = C.topics(spark, sf)
    out = None
    for m in ["content", "segment", "cold_start"]:
        c = EV.coverage(recs.filter(F.col("method") == m), t, 5).select(F.lit(m).alias("method"), "coverage")
        out = c if out is None else out.unionByName(c)
    return out


SEG_EVAL_SQL = """segs AS (SELECT student_id, CASE WHEN n - 1 < 2 THEN 'cold_start' WHEN quiz_score < 55 THEN 'struggling' ELSE 'regular' END AS segment
  FROM learners, (SELECT COUNT(*) AS n FROM learners) c)"""


@register("f22_evaluation_report", f"""WITH {RECS_SQL}, {REL_SQL}, {metrics_sql(5, "AND method = 'content'")}, {SEG_EVAL_SQL},
j AS (SELECT r.*, s.segment FROM rm5 r LEFT JOIN segs s USING (student_id))
SELECT COALESCE(segment, 'global') AS segment, CAST(COUNT(*) AS BIGINT) AS samples,
  {', '.join(f"{sq(f'AVG({m})')} AS {m}" for m in EV.METRICS)}
FROM j GROUP BY ROLLUP (segment)""", LT)
def f22(spark, sf):
    recs = _recs(spark, sf).filter(F.col("method") == "content")
    per = EV.ranking_metrics(recs, _rel(spark, sf), "student_id", 5)
    l = C.learners(spark, sf)
    n = l.agg(F.count(F.lit(1)).alias("__n"))
    segs = l.crossJoin(F.broadcast(n)).select("student_id", S.eval_segment(F.col("__n") - 1, "quiz_score").alias("segment"))
    r = EV.evaluation_report(per, segs, "student_id")
    return r.select("segment", "samples", *[scaled(m).alias(m) for m in EV.METRICS])


@register("f23_difficulty_relevance", f"WITH {REL_SQL}\nSELECT student_id, topic FROM rel", LT)
def f23(spark, sf):
    return _rel(spark, sf)


@register("f24_subject_relevance", """WITH r AS (SELECT l.student_id, t.topic FROM learners l JOIN topics t ON t.subject = l.subject_weakness)
SELECT student_id, topic, (SELECT CAST(COUNT(*) AS DOUBLE) / COUNT(DISTINCT student_id) FROM r) AS avg_relevant FROM r""", LT)
def f24(spark, sf):
    r = EV.subject_relevance(C.learners(spark, sf), C.topics(spark, sf))
    avg = r.agg((F.count(F.lit(1)).cast("double") / F.count_distinct("student_id")).alias("avg_relevant"))
    return r.crossJoin(F.broadcast(avg))


def _methods_sql():
    parts = []
    for k in (3, 5, 10):
        parts.append(f"SELECT method, {k} AS k, {sq('AVG(hit)')} AS hit, {sq('AVG(precision)')} AS precision, "
                     f"{sq('AVG(recall)')} AS recall, {sq('AVG(ndcg)')} AS ndcg FROM rm{k} GROUP BY method")
    return " UNION ALL ".join(parts)


METHODS_SQL = f"""{RECS_SQL}, {REL_SQL}, {metrics_sql(3)}, {metrics_sql(5).replace('nr AS (SELECT student_id, COUNT(*) AS n_relevant FROM (SELECT DISTINCT * FROM rel) d GROUP BY student_id),', '')},
{metrics_sql(10).replace('nr AS (SELECT student_id, COUNT(*) AS n_relevant FROM (SELECT DISTINCT * FROM rel) d GROUP BY student_id),', '')},
pm AS ({_methods_sql()})"""


def _per_method(spark, sf):
    m = EV.evaluate_methods(_recs(spark, sf), _rel(spark, sf), "student_id", (3, 5, 10),
                            methods=["content", "segment", "cold_start"])
    return m.select("method", F.col("k").cast("int").alias("k"),
                    *[scaled(c).alias(c) for c in ["hit", "precision", "recall", "ndcg"]])


@register("f25_methods_at_k", f"WITH {METHODS_SQL}\nSELECT method, CAST(k AS INT) AS k, hit, precision, recall, ndcg FROM pm", LT)
def f25(spark, sf):
    return _per_method(spark, sf)


@register("f26_comparison_matrix", f"""WITH {METHODS_SQL},
lg AS (SELECT method, CAST(k AS INT) AS k, UNNEST(['hit', 'precision', 'recall', 'ndcg']) AS metric,
              UNNEST([hit, precision, recall, ndcg]) AS value FROM pm)
SELECT k, metric, MAX(value) FILTER (WHERE method = 'content') AS content,
       MAX(value) FILTER (WHERE method = 'segment') AS segment,
       MAX(value) FILTER (WHERE method = 'cold_start') AS cold_start
FROM lg GROUP BY k, metric""", LT)
def f26(spark, sf):
    return EV.comparison_matrix(_per_method(spark, sf), ["content", "segment", "cold_start"])


@register("f27_best_method", f"""WITH {METHODS_SQL},
lg AS (SELECT method, CAST(k AS INT) AS k, UNNEST(['hit', 'precision', 'recall', 'ndcg']) AS metric,
              UNNEST([hit, precision, recall, ndcg]) AS value FROM pm)
SELECT k, metric, method AS best_method, value AS best_value FROM lg
QUALIFY ROW_NUMBER() OVER (PARTITION BY k, metric ORDER BY value DESC, method) = 1""", LT)
def f27(spark, sf):
    return EV.best_method(_per_method(spark, sf))


@register("f28_cv_summary", f"""WITH {RECS_SQL}, {REL_SQL}, {metrics_sql(5, "AND method = 'content'")},
fo AS (SELECT r.*, ('0x' || substr(md5('42:' || CAST(student_id AS VARCHAR)), 1, 8))::BIGINT % 5 AS fold FROM rm5 r),
pf AS (SELECT fold, AVG(hit) AS hit, AVG(ndcg) AS ndcg FROM fo GROUP BY fold)
SELECT CAST(COUNT(*) AS BIGINT) AS folds, {sq('AVG(hit)')} AS cv_hit_mean, {sq('STDDEV_SAMP(hit)')} AS cv_hit_std,
       {sq('AVG(ndcg)')} AS cv_ndcg_mean, {sq('STDDEV_SAMP(ndcg)')} AS cv_ndcg_std FROM pf""", LT)
def f28(spark, sf):
    recs = _recs(spark, sf).filter(F.col("method") == "content")
    per = EVT.fold_assignment(EV.ranking_metrics(recs, _rel(spark, sf), "student_id", 5), "student_id", 5)
    pf = per.groupBy("fold").agg(F.avg("hit").alias("hit"), F.avg("ndcg").alias("ndcg"))
    s = EV.cv_summary(pf, ["hit", "ndcg"])
    return s.select(F.col("folds").cast("bigint").alias("folds"),
                    *[scaled(c).alias(c) for c in ["cv_hit_mean", "cv_hit_std", "cv_ndcg_mean", "cv_ndcg_std"]])


@register("f29_ab_lift", f"""WITH {RECS_SQL}, {REL_SQL}, {metrics_sql(5, "AND method = 'content'")},
v AS (SELECT r.*, CASE WHEN ('0x' || substr(md5('reco_v3:' || CAST(student_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 50 THEN 'B' ELSE 'A' END AS variant FROM rm5 r)
SELECT {sq("AVG(hit) FILTER (WHERE variant = 'A')")} AS variant_a, {sq("AVG(hit) FILTER (WHERE variant = 'B')")} AS variant_b,
       {sq("AVG(hit) FILTER (WHERE variant = 'B') - AVG(hit) FILTER (WHERE variant = 'A')")} AS lift FROM v""", LT)
def f29(spark, sf):
    recs = _recs(spark, sf).filter(F.col("method") == "content")
    per = EV.ranking_metrics(recs, _rel(spark, sf), "student_id", 5)
    var = C.learners(spark, sf).select(
        "student_id", F.when(S.ab_bucket("student_id") == "treatment", "B").otherwise("A").alias("variant"))
    r = EV.ab_lift(per, var, "student_id")
    return r.select(*[scaled(c).alias(c) for c in ["variant_a", "variant_b", "lift"]])


@register("f32_tuning_objective", f"""WITH {RECS_SQL}, {REL_SQL}, {metrics_sql(3)},
{metrics_sql(5).replace('nr AS (SELECT student_id, COUNT(*) AS n_relevant FROM (SELECT DISTINCT * FROM rel) d GROUP BY student_id),', '')},
{metrics_sql(7).replace('nr AS (SELECT student_id, COUNT(*) AS n_relevant FROM (SELECT DISTINCT * FROM rel) d GROUP BY student_id),', '')},
{SEG_EVAL_SQL},
g AS ({' UNION ALL '.join(f"SELECT method || ':' || '{k}' AS grid_id, r.*, s.segment FROM rm{k} r LEFT JOIN segs s USING (student_id)" for k in (3, 5, 7))}),
cov AS ({' UNION ALL '.join(f"SELECT method || ':' || '{k}' AS grid_id, COUNT(DISTINCT topic) / GREATEST((SELECT COUNT(DISTINCT topic) FROM topics), 1) AS coverage FROM recs WHERE rnk <= {k} GROUP BY method" for k in (3, 5, 7))}),
gm AS (SELECT grid_id, AVG(hit) AS hit, AVG(ndcg) AS ndcg, AVG(map) AS map,
              AVG(hit) FILTER (WHERE segment = 'cold_start') AS cold_start_hit,
              AVG(hit) FILTER (WHERE segment = 'struggling') AS struggling_hit FROM g GROUP BY grid_id),
o AS (SELECT gm.*, cov.coverage,
        0.30 * COALESCE(hit, 0.0) + 0.20 * COALESCE(ndcg, 0.0) + 0.15 * COALESCE(map, 0.0) + 0.15 * COALESCE(coverage, 0.0)
        + 0.15 * COALESCE(cold_start_hit, 0.0) + 0.05 * COALESCE(struggling_hit, 0.0) AS objective
      FROM gm JOIN cov USING (grid_id))
SELECT grid_id, {sq('objective')} AS objective,
  CAST(ROW_NUMBER() OVER (ORDER BY FLOOR(COALESCE(hit, 0.0) * 1e12 + 0.5) DESC, FLOOR(COALESCE(cold_start_hit, 0.0) * 1e12 + 0.5) DESC,
                           FLOOR(COALESCE(ndcg, 0.0) * 1e12 + 0.5) DESC, FLOOR(COALESCE(map, 0.0) * 1e12 + 0.5) DESC, grid_id) AS INT) AS grid_rank
FROM o""", LT)
def f32(spark, sf):
    recs = _recs(spark, sf)
    rel = _rel(spark, sf)
    l = C.learners(spark, sf)
    n = l.agg(F.count(F.lit(1)).alias("__n"))
    segs = l.crossJoin(F.broadcast(n)).select("student_id", S.eval_segment(F.col("__n") - 1, "quiz_score").alias("segment"))
    t = C.topics(spark, sf)
    rows = None
    for k in (3, 5, 7):
        per = EV._method_metrics(recs.filter(F.col("rnk") <= k), rel, "student_id", k).join(segs, "student_id", "left")
        gm = per.groupBy("method").agg(
            F.avg("hit").alias("hit"), F.avg("ndcg").alias("ndcg"), F.avg("map").alias("map"),
            F.avg(F.when(F.col("segment") == "cold_start", F.col("hit"))).alias("cold_start_hit"),
            F.avg(F.when(F.col("segment") == "struggling", F.col("hit"))).alias("struggling_hit"))
        cov = recs.filter(F.col("rnk") <= k).groupBy("method").agg(F.count_distinct("topic").alias("__r")).crossJoin(
            t.agg(F.count_distinct("topic").alias("__c"))).select(
            "method", (F.col("__r") / F.greatest(F.col("__c"), F.lit(1))).alias("coverage"))
        g = gm.join(cov, "method").withColumn("grid_id", F.concat(F.col("method"), F.lit(f":{k}")))
        rows = g if rows is None else rows.unionByName(g)
    r = EV.tuning_objective(rows)
    return r.select("grid_id", scaled("objective").alias("objective"), "grid_rank")

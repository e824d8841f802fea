"""Registered queries: exact neighbour join and collaborative candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathwise.functions import constants as K
from pathwise.functions.expressions import scaled
from pathwise.operators import knn as KN
from pathwise.plans import common as C
from pathwise.plans.catalog import register
from pathwise.plans.q_scoring import FINAL
from pathwise.plans.sqlparts import FEAT_CTE, scaled as sq

NEIGHBOURS = 6  # fixed value: default neighbour count
LT = ("learners", "topics")


def neighbour_pairs(spark, sf, k: int = NEIGHBOURS, metric: str = "euclidean"):
    f = C.features(spark, sf)
    space, _dims = KN.feature_space(f, "student_id", K.RICH_FEATURES, K.CAT_FEATURES)
    return KN.knn(space, k, "student_id", metric=metric)


def _num_terms():
    return " + ".join(
        f"(CASE WHEN s_{c} = 0 THEN 1.0 ELSE s_{c} END) ^ -2 * (COALESCE(a.{c}, 0) - COALESCE(b.{c}, 0)) ^ 2"
        for c in K.RICH_FEATURES)


def _cat_terms():
    parts = []
    for c in K.CAT_FEATURES:
        parts.append(f"""CASE WHEN COALESCE(CAST(a.{c} AS VARCHAR), 'Unknown') = COALESCE(CAST(b.{c} AS VARCHAR), 'Unknown') THEN 0.0
  ELSE (SELECT 1.0 / CASE WHEN sd = 0 THEN 1.0 ELSE sd * sd END FROM dsd WHERE col = '{c}' AND val = COALESCE(CAST(a.{c} AS VARCHAR), 'Unknown'))
     + (SELECT 1.0 / CASE WHEN sd = 0 THEN 1.0 ELSE sd * sd END FROM dsd WHERE col = '{c}' AND val = COALESCE(CAST(b.{c} AS VARCHAR), 'Unknown')) END""")
    return " + ".join(parts)


KNN_SQL = f"""{FEAT_CTE.strip()},
ns AS (SELECT {', '.join(f'STDDEV_POP(COALESCE({c}, 0)) AS s_{c}' for c in K.RICH_FEATURES)} FROM feat),
cv AS ({' UNION ALL '.join(f"SELECT '{c}' AS col, COALESCE(CAST({c} AS VARCHAR), 'Unknown') AS val FROM feat" for c in K.CAT_FEATURES)}),
dsd AS (SELECT col, val, SQRT(p * (1 - p)) AS sd FROM (
          SELECT col, val, COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY col) AS p FROM cv GROUP BY col, val) x),
pr AS (SELECT a.student_id, b.student_id AS neighbour, SQRT({_num_terms()} + {_cat_terms()}) AS d
       FROM feat a JOIN feat b ON a.student_id <> b.student_id, ns),
nb AS (SELECT student_id, neighbour, d, ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY d, neighbour) AS rnk
       FROM pr QUALIFY rnk <= {NEIGHBOURS})"""


@register("d05_knn_join", f"WITH {KNN_SQL}\nSELECT student_id, neighbour, {sq('d')} AS distance, CAST(rnk AS INT) AS rnk FROM nb",
          ("learners",))
def d05(spark, sf):
    p = neighbour_pairs(spark, sf)
    return p.select("student_id", "neighbour", scaled("distance").alias("distance"), "rnk")


@register("d06_collaborative_candidates", f"""WITH {KNN_SQL},
fs AS (SELECT student_id AS nid, subject_strength AS ss, subject_weakness AS sw, quiz_score AS nq,
              {FINAL} AS nf FROM feat),
p AS (SELECT nb.student_id, 1.0 / (1.0 + nb.d) AS sim, fs.* FROM nb JOIN fs ON fs.nid = nb.neighbour),
parts AS (
  SELECT p.student_id, t.topic, sim * (0.9 + nf / 120.0) / t.rnk + CASE WHEN nq >= 75 AND t.rnk >= 3 THEN sim * 0.2 ELSE 0.0 END AS s
  FROM p JOIN topics t ON t.subject = p.ss
  UNION ALL
  SELECT p.student_id, t.topic, sim * (0.4 + GREATEST(0.0, 70.0 - nq) / 70.0) / t.rnk FROM p JOIN topics t ON t.subject = p.sw
  UNION ALL
  SELECT l.student_id, t.topic, 0.2 / t.rnk FROM learners l JOIN topics t ON t.subject = l.subject_weakness),
sc AS (SELECT student_id, topic, SUM(s) AS v FROM parts GROUP BY student_id, topic)
SELECT student_id, topic, {sq('v')} AS collab_score,
       CAST(ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY v DESC, topic) AS INT) AS rnk
FROM sc QUALIFY rnk <= 12""", LT)
def d06(spark, sf):
    pairs = neighbour_pairs(spark, sf)
    r = KN.neighbour_topic_scores(pairs, C.features(spark, sf), C.topics(spark, sf))
    return r.select("student_id", "topic", scaled("collab_score").alias("collab_score"), "rnk")


_LOO = ["quiz_score", "attendance", "previous_score"]


@register("d18_loo_statistics", f"""SELECT a.student_id,
  {', '.join(f"{sq(f'(SELECT AVG(b.{c}) FROM learners b WHERE b.student_id <> a.student_id)')} AS {c}_loo_mean, "
             f"{sq(f'(SELECT STDDEV_POP(b.{c}) FROM learners b WHERE b.student_id <> a.student_id)')} AS {c}_loo_std" for c in _LOO)}
FROM learners a""", ("learners",))
def d18(spark, sf):
    r = KN.loo_statistics(C.learners(spark, sf), _LOO, "student_id")
    return r.select("student_id", *[scaled(f"{c}_loo_{s}").alias(f"{c}_loo_{s}") for c in _LOO for s in ("mean", "std")])

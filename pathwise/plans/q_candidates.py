"""Registered queries: candidate generation and lookup joins (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathwise.functions import constants as K
from pathwise.functions.expressions import scaled
from pathwise.operators import candidates as D
from pathwise.operators import events as EV
from pathwise.operators import scoring as S
from pathwise.operators.evaluation import difficulty_relevance
from pathwise.plans import common as C
from pathwise.plans.catalog import register
from pathwise.plans.sqlparts import FEAT_CTE, scaled as sq

LT = ("learners", "topics")
LTE = ("learners", "topics", "feedback_events")

# Ordered-topic CTE used by several oracles: learner x own topics in prior order.
PRIOR_SQL = """prior AS (
  SELECT l.student_id, l.quiz_score, t.topic,
         ROW_NUMBER() OVER (PARTITION BY l.student_id ORDER BY CASE WHEN l.quiz_score >= 70 THEN -t.rnk ELSE t.rnk END) AS pos,
         0 AS prio
  FROM learners l JOIN topics t ON t.subject = l.subject_weakness
  UNION ALL
  SELECT l.student_id, l.quiz_score, t.topic, t.topic_idx + 1 AS pos, 0 AS prio
  FROM learners l JOIN topics t ON true
  WHERE l.subject_weakness IS NULL OR l.subject_weakness NOT IN (SELECT subject FROM topics))"""

# fixed binding parameters: band -> three subjects of the fixture library
SEGMENTS = {"low": ["ECONOMY", "LARGE", "MEDIUM"], "mid": ["PROMO", "SMALL", "STANDARD"],
            "high": ["LARGE", "PROMO", "STANDARD"]}


@register("d01_content_candidates", f"""WITH {PRIOR_SQL}
SELECT student_id, quiz_score, topic, CAST(pos AS INT) AS rnk, 'content' AS source FROM prior WHERE pos <= 10""", LT)
def d01(spark, sf):
    return D.content_candidates(C.learners(spark, sf), C.topics(spark, sf), 10)


@register("d02_cold_start", f"""WITH {PRIOR_SQL},
u AS (SELECT student_id, topic, prio, pos FROM prior WHERE pos <= 5
      UNION ALL SELECT l.student_id, t.topic, 1, t.topic_idx + 1 FROM learners l JOIN topics t ON t.topic_idx < 10),
d AS (SELECT student_id, topic, ROW_NUMBER() OVER (PARTITION BY student_id, topic ORDER BY prio, pos) AS f, prio, pos FROM u)
SELECT student_id, topic, CAST(ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY prio, pos) AS INT) AS rnk,
       'cold_start' AS source
FROM d WHERE f = 1 QUALIFY rnk <= 5""", LT)
def d02(spark, sf):
    return D.cold_start(C.learners(spark, sf), C.topics(spark, sf), 5)


def _seg_ctes():
    rows = " UNION ALL ".join(f"SELECT '{b}' AS band, {i} AS i, '{s}' AS subject"
                              for b, subs in SEGMENTS.items() for i, s in enumerate(subs))
    return f"""seg AS ({rows}),
pool AS (SELECT band, topic, ROW_NUMBER() OVER (PARTITION BY band ORDER BY i, rnk) AS pos
         FROM seg JOIN topics USING (subject)),
lb AS (SELECT student_id, CASE WHEN quiz_score < 55 THEN 'low' WHEN quiz_score < 75 THEN 'mid' ELSE 'high' END AS band FROM learners)"""


def _seg_sql():
    return f"""WITH {_seg_ctes()}
SELECT student_id, topic, CAST(pos AS INT) AS rnk, 'segment' AS source FROM lb JOIN pool USING (band) WHERE pos <= 5"""


@register("d03_segment_popular", _seg_sql(), LT)
def d03(spark, sf):
    return D.segment_popular(C.learners(spark, sf), C.topics(spark, sf), SEGMENTS, 5)


@register("d04_global_popular", """SELECT topic, CAST(topic_idx + 1 AS INT) AS rnk, 'global' AS source
FROM topics WHERE topic_idx < 5""", ("topics",))
def d04(spark, sf):
    return D.global_popular(C.topics(spark, sf), 5)


@register("d08_cosine_top_k", f"""WITH {C.CENTROIDS_SQL},
items AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT label, vec_id,
        list_dot_product(list_transform(c.vec, lambda x: x / sqrt(list_dot_product(c.vec, c.vec))),
                         list_transform(i.v, lambda x: x / sqrt(list_dot_product(i.v, i.v)))) AS sim
      FROM cen c, items i)
SELECT label, vec_id, {sq('sim')} AS similarity,
       CAST(ROW_NUMBER() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS INT) AS rnk
FROM s QUALIFY rnk <= 10""")
def d08(spark, sf):
    cen = C.label_centroids(spark, sf)
    items = C.tables.read_table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    r = D.cosine_top_k(cen, items, 10, "label", "vec_id")
    return r.select("label", "vec_id", scaled("similarity").alias("similarity"), "rnk")


@register("d09_lsh_neighbours")
def d09(spark, sf):
    """The five nearest of every vector among the pairs that share an LSH bucket."""
    items = C.tables.read_table(spark, sf, "embeddings")
    return D.lsh_neighbours(items, "vec_id", "embedding", threshold=1.3, bucket_length=1.0, num_tables=8, k=5)


@register("d10_user_item_scores", f"""WITH {C.CENTROIDS_SQL},
s AS (SELECT c.label, e.vec_id, list_dot_product(c.vec, CAST(e.embedding AS DOUBLE[])) + 0.05 * (1.0 / (1 + e.vec_id)) AS score
      FROM cen c, embeddings e)
SELECT label, vec_id, {sq('score')} AS score,
       CAST(ROW_NUMBER() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INT) AS rnk FROM s""")
def d10(spark, sf):
    cen = C.label_centroids(spark, sf)
    items = C.tables.read_table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").alias("vec"), (F.lit(1.0) / (F.col("vec_id") + 1)).alias("popularity"))
    r = D.user_item_scores(cen, items, "label", "vec_id")
    return r.select("label", "vec_id", scaled("score").alias("score"), "rnk")


@register("d12_item_feature_lookup", f"""WITH {C.RATED_EVENTS_SQL},
it AS (SELECT item_id, CAST(SUM(CASE WHEN event_type = 'recommendation_clicked' THEN 1 ELSE 0 END) AS DOUBLE)
                 / GREATEST(SUM(CASE WHEN event_type = 'recommendation_shown' THEN 1 ELSE 0 END), 1) AS item_ctr,
              MAX(timestamp_utc) AS last_ts FROM ev WHERE item_id IS NOT NULL GROUP BY item_id),
at_time AS (SELECT MAX(timestamp_utc) AS t FROM ev),
{PRIOR_SQL[:-1]}),
c AS (SELECT student_id, topic, CAST(pos AS INT) AS rnk FROM prior WHERE pos <= 10),
j AS (SELECT c.*, COALESCE((epoch_us(at_time.t) - epoch_us(it.last_ts)) / 3.6e9, 72.0) AS recency_hours,
             COALESCE(it.item_ctr, 0.3) AS popularity
      FROM c LEFT JOIN it ON c.topic = it.item_id CROSS JOIN at_time)
SELECT student_id, topic, rnk, 0.5 AS embedding_similarity, {sq('recency_hours')} AS recency_hours,
       {sq('popularity')} AS popularity, 0.5 AS difficulty_match, {sq('1.0 / (1.0 + recency_hours / 24.0)')} AS freshness
FROM j""", LTE)
def d12(spark, sf):
    ev = C.rated_events(spark, sf)
    items = _item_features(ev)
    asof = ev.agg(F.max("timestamp_utc").alias("__asof"))
    cands = D.content_candidates(C.learners(spark, sf), C.topics(spark, sf), 10).crossJoin(F.broadcast(asof))
    r = D.item_feature_lookup(cands, items, "topic", F.col("__asof"))
    return r.select("student_id", "topic", "rnk", "embedding_similarity", scaled("recency_hours").alias("recency_hours"),
                    scaled("popularity").alias("popularity"), "difficulty_match", scaled("freshness").alias("freshness"))


def _item_features(ev):
    et = F.col("event_type")
    return ev.filter(F.col("item_id").isNotNull()).groupBy("item_id").agg(
        (F.sum(F.when(et == "recommendation_clicked", 1).otherwise(0)).cast("double")
         / F.greatest(F.sum(F.when(et == "recommendation_shown", 1).otherwise(0)), F.lit(1))).alias("item_ctr"),
        F.max("timestamp_utc").alias("last_event_ts"))


@register("d13_user_feature_lookup", f"""WITH {C.RATED_EVENTS_SQL},
snap AS (SELECT user_id, CAST(SUM(CASE WHEN event_type = 'recommendation_clicked' THEN 1 ELSE 0 END) AS DOUBLE) / GREATEST(COUNT(*), 1) AS ctr,
                CAST(SUM(CASE WHEN event_type = 'lesson_completed' THEN 1 ELSE 0 END) AS DOUBLE) / GREATEST(COUNT(*), 1) AS completion_rate
         FROM ev WHERE timestamp_utc IS NOT NULL GROUP BY user_id)
SELECT student_id, COALESCE(ctr, 0.1) AS ctr, COALESCE(completion_rate, 0.3) AS completion_rate
FROM learners LEFT JOIN snap ON student_id = user_id""", LTE)
def d13(spark, sf):
    snap = EV.user_snapshot(C.rated_events(spark, sf))
    return D.user_feature_lookup(C.learners(spark, sf).select("student_id"), snap, "student_id").select(
        "student_id", "ctr", "completion_rate")


@register("d14_point_lookup", """SELECT student_id, subject_weakness, quiz_score FROM learners
WHERE student_id IN (SELECT user_id FROM feedback_events)""", ("learners", "feedback_events"))
def d14(spark, sf):
    keys = C.events(spark, sf).select(F.col("user_id").alias("student_id"))
    found, _missing = D.point_lookup(C.learners(spark, sf).select("student_id", "subject_weakness", "quiz_score"),
                                     keys, "student_id")
    return found


@register("d15_first_wins_merge", f"""WITH {PRIOR_SQL[:-1]}),
{_seg_ctes()},
segl AS (SELECT student_id, topic, pos FROM lb JOIN pool USING (band) WHERE pos <= 5),
u AS (SELECT student_id, topic, 0 AS so, pos FROM prior WHERE pos <= 10
      UNION ALL SELECT student_id, topic, 1, pos FROM segl),
f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY student_id, topic ORDER BY so, pos) AS r FROM u)
SELECT student_id, topic, CAST(ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY so, pos) AS INT) AS merged_rnk
FROM f WHERE r = 1""", LT)
def d15(spark, sf):
    l, t = C.learners(spark, sf), C.topics(spark, sf)
    lists = D.content_candidates(l, t, 10).select("student_id", "topic", "rnk", "source").unionByName(
        D.segment_popular(l, t, SEGMENTS, 5))
    return D.first_wins_merge(lists, "student_id", {"content": 0, "segment": 1}).select(
        "student_id", "topic", "merged_rnk")


@register("d16_known_key_suppression", """WITH k AS (
  SELECT event_id, timestamp_utc, sha256(to_json({'event_type': event_type, 'item_id': CAST(topic_idx AS VARCHAR),
      'payload': '{}', 'session_id': session_id, 'timestamp_utc': strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S.%f'),
      'user_id': CAST(user_id AS VARCHAR)})) AS idempotency_key FROM feedback_events),
known AS (SELECT idempotency_key FROM k WHERE timestamp_utc < TIMESTAMP '2024-01-16')
SELECT idempotency_key, MIN(event_id) AS event_id FROM k
WHERE idempotency_key NOT IN (SELECT idempotency_key FROM known)
GROUP BY idempotency_key""", ("feedback_events",))
def d16(spark, sf):
    e = C.events(spark, sf)
    e = e.withColumn("idempotency_key", S.idempotency_key(
        F.lit(None).cast("string"), item=F.col("topic_idx").cast("string"), payload=F.lit("{}")))
    known = e.filter(F.col("timestamp_utc") < F.lit("2024-01-16").cast("timestamp_ntz"))
    new = e.groupBy("idempotency_key").agg(F.min("event_id").alias("event_id"))
    return D.suppress_known(new, known, "idempotency_key").select("idempotency_key", "event_id")


@register("d17_relevance_flag", f"""WITH {PRIOR_SQL[:-1]}),
rel AS (
  SELECT l.student_id, t.topic FROM learners l JOIN topics t ON t.subject = l.subject_weakness
  JOIN (SELECT subject, MAX(rnk) AS n FROM topics GROUP BY subject) m ON m.subject = t.subject
  WHERE (l.quiz_score < 50 AND t.rnk <= 3)
     OR (l.quiz_score >= 50 AND l.quiz_score < 70 AND (m.n <= 3 OR t.rnk BETWEEN 2 AND 4))
     OR (l.quiz_score >= 70 AND (m.n < 3 OR t.rnk > m.n - 3)))
SELECT p.student_id, p.topic, CAST(p.pos AS INT) AS rnk,
       CASE WHEN EXISTS (SELECT 1 FROM rel r WHERE r.student_id = p.student_id AND r.topic = p.topic) THEN 1 ELSE 0 END AS hit
FROM prior p WHERE pos <= 5""", LT)
def d17(spark, sf):
    l, t = C.learners(spark, sf), C.topics(spark, sf)
    recs = D.content_candidates(l, t, 5).select("student_id", "topic", "rnk")
    return D.relevance_flag(recs, difficulty_relevance(l, t), "student_id")


@register("d19_as_of_features", f"""WITH {C.RATED_EVENTS_SQL},
lab AS (SELECT user_id, timestamp_utc AS label_ts FROM ev WHERE event_type = 'lesson_completed')
SELECT lab.user_id, lab.label_ts,
  CAST((SELECT COUNT(*) FROM ev e WHERE e.user_id = lab.user_id AND e.timestamp_utc <= lab.label_ts) AS BIGINT) AS interactions,
  CAST((SELECT COUNT(*) FROM ev e WHERE e.user_id = lab.user_id AND e.timestamp_utc <= lab.label_ts
          AND e.event_type = 'recommendation_clicked') AS BIGINT) AS clicks
FROM lab""", ("topics", "feedback_events"))
def d19(spark, sf):
    ev = C.rated_events(spark, sf)
    labels = ev.filter(F.col("event_type") == "lesson_completed").select(
        "user_id", F.col("timestamp_utc").alias("label_ts"))
    vals = {"interactions": F.lit(1), "clicks": F.when(F.col("event_type") == "recommendation_clicked", 1).otherwise(0)}
    return EV.as_of_counts(ev, labels, "user_id", "timestamp_utc", "label_ts", vals)


@register("d20_shared_column_pairing", f"""WITH {FEAT_CTE.strip()},
s AS (SELECT *, ('0x' || substr(md5('42:' || CAST(student_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 80 AS is_train FROM feat),
l AS ({' UNION ALL '.join(f"SELECT is_train, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM s" for c in K.NUMERIC_FEATURES)})
SELECT a.feature, a.n AS reference_n, b.n AS current_n, a.mx AS reference_max, b.mx AS current_max
FROM (SELECT feature, COUNT(v) AS n, MAX(v) AS mx FROM l WHERE is_train GROUP BY feature) a
JOIN (SELECT feature, COUNT(v) AS n, MAX(v) AS mx FROM l WHERE NOT is_train GROUP BY feature) b USING (feature)""", ("learners",))
def d20(spark, sf):
    f = EV.hash_split(C.features(spark, sf), "student_id")
    cols = K.NUMERIC_FEATURES
    ref, cur = D.pair_shared_columns(f.filter("is_train").select(*cols), f.filter("NOT is_train").select(*cols))
    a = ref.groupBy("feature").agg(F.count("reference_value").alias("reference_n"), F.max("reference_value").alias("reference_max"))
    b = cur.groupBy("feature").agg(F.count("current_value").alias("current_n"), F.max("current_value").alias("current_max"))
    return a.join(b, "feature")


@register("d21_negative_sampling", """WITH pos AS (
  SELECT DISTINCT user_id, topic_idx FROM feedback_events WHERE event_type = 'recommendation_clicked'),
dr AS (SELECT user_id, topic_idx, t AS try,
         CAST(('0x' || substr(md5('42:' || CAST(user_id AS VARCHAR) || ':' || CAST(topic_idx AS VARCHAR) || ':' || CAST(t AS VARCHAR)), 1, 8))::BIGINT % (SELECT COUNT(*) FROM (SELECT DISTINCT p_type, p_brand FROM part) pt) AS INT) AS neg
       FROM pos, range(1, 11) r(t)),
ok AS (SELECT * FROM dr WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.user_id = dr.user_id AND p.topic_idx = dr.neg))
SELECT user_id, topic_idx AS item_idx, neg, CAST(try AS INT) AS try FROM ok
QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id, topic_idx ORDER BY try) = 1""", ("feedback_events",))
def d21(spark, sf):
    pos = (C.events(spark, sf).filter(F.col("event_type") == "recommendation_clicked")
           .select("user_id", F.col("topic_idx").alias("item_idx")).distinct())
    return D.negative_samples(pos, C.tables.n_topics(spark, sf), "user_id", "item_idx")


@register("d11_retrieval_ladder")
def d11(spark, sf):
    from pathwise.streaming.feedback import online_user_vectors_batch
    l, t = C.learners(spark, sf), C.topics(spark, sf)
    ev = C.rated_events(spark, sf).withColumn("event_ts", F.col("timestamp_utc").cast("timestamp")) \
        .withColumn("reward", S.event_reward("event_type", "rating"))
    ev = ev.withColumn("item_vec", F.when(F.col("item_id").isNotNull(), S.hashed_vector("item_id"))
                       .otherwise(F.array(F.lit(1.0), *[F.lit(0.0)] * 8)))
    uvec = online_user_vectors_batch(ev).select(F.col("user_id").alias("student_id"), F.col("vector").alias("vec"))
    tv = t.select("topic", S.hashed_vector("topic").alias("vec"))
    ann = D.cosine_top_k(uvec, tv, 15, "student_id", "topic").select("student_id", "topic", "rnk")
    cold = D.cold_start(l, t, 15).select("student_id", "topic", "rnk")
    content = D.content_candidates(l, t, 15).select("student_id", "topic", "rnk")
    return D.retrieval_ladder(ann, uvec.select("student_id"), cold, content, "student_id", 15)

"""Registered queries: scoring, banding, explanation and hashing (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathwise.functions.expressions import clip
from pathwise.operators import scoring as S
from pathwise.operators.candidates import content_candidates
from pathwise.plans import common as C
from pathwise.plans.catalog import register
from pathwise.plans.sqlparts import FEAT_CTE, RISK, clip as sc

LV = ("learners",)
FINAL = sc("0.30 * quiz_score + 0.20 * assignment_score + 0.15 * attendance + 0.15 * consistency_score"
           " + 0.10 * previous_score + 0.05 * engagement_score + 0.05 * learning_efficiency", 10, 100)
SCORED = f"WITH {FEAT_CTE.strip()}, sc AS (SELECT *, {FINAL} AS final_score FROM feat)\n"


def _feat(spark, sf):
    return C.features(spark, sf)


@register("c01_risk_band", SCORED + f"SELECT student_id, {RISK.format(s='final_score')} AS risk_level FROM sc", LV)
def c01(spark, sf):
    return _feat(spark, sf).select("student_id", S.risk_level("final_score").alias("risk_level"))


@register("c02_risk_band_inclusive", SCORED + """SELECT student_id,
  CASE WHEN final_score < 50 THEN 'high' WHEN final_score <= 70 THEN 'medium' ELSE 'low' END AS risk_level FROM sc""", LV)
def c02(spark, sf):
    return _feat(spark, sf).select("student_id", S.risk_level("final_score", True).alias("risk_level"))


@register("c03_learner_class", SCORED + """SELECT student_id,
  CASE WHEN final_score >= 75 AND engagement_score >= 60 THEN 'Fast Learner'
       WHEN final_score < 55 OR engagement_score < 35 THEN 'Struggling Learner'
       ELSE 'Low Engagement' END AS learning_type FROM sc""", LV)
def c03(spark, sf):
    return _feat(spark, sf).select("student_id", S.learner_class("final_score", "engagement_score").alias("learning_type"))


@register("c04_explanation", SCORED + """SELECT student_id,
  'This student shows ' || COALESCE(NULLIF(concat_ws(', ',
      CASE WHEN final_score < 55 THEN 'low predicted performance' END,
      CASE WHEN engagement_score < 35 THEN 'low engagement' END,
      CASE WHEN attempts > 6 THEN 'high attempts' END,
      CASE WHEN consistency_score < 50 THEN 'inconsistent performance' END), ''),
    'strong overall performance') || '.' AS explanation FROM sc""", LV)
def c04(spark, sf):
    return _feat(spark, sf).select("student_id", S.explanation(
        "final_score", "engagement_score", "attempts", "consistency_score").alias("explanation"))


@register("c05_weak_areas", """SELECT student_id,
  COALESCE(NULLIF(concat_ws('|',
     CASE WHEN quiz_score < 60 THEN COALESCE(subject_weakness, 'General Studies') END,
     CASE WHEN attendance < 60 THEN 'Attendance / Consistency' END,
     CASE WHEN assignment_score < 55 THEN 'Assignment Completion' END), ''), 'None') AS weak_areas,
  concat_ws('|', CASE WHEN quiz_score < 60 THEN COALESCE(subject_weakness, 'General') END,
                 CASE WHEN attendance < 60 THEN 'Attendance' END) AS profile_weak_areas
FROM learners""", LV)
def c05(spark, sf):
    df = C.learners(spark, sf)
    return df.select("student_id",
                     F.array_join(S.weak_areas("quiz_score", "attendance", "assignment_score", "subject_weakness"), "|").alias("weak_areas"),
                     F.array_join(S.weak_areas_profile("quiz_score", "attendance", "subject_weakness"), "|").alias("profile_weak_areas"))


@register("c06_confidence", SCORED + f"""SELECT student_id,
  {sc("0.35 + 0.3 * LEAST(1.0, ABS(final_score - 50.0) / 50.0) + 0.35 * " + sc("(engagement_score + consistency_score) / 200.0", 0.0, 1.0), 0.25, 0.95)} AS confidence
FROM sc""", LV)
def c06(spark, sf):
    return _feat(spark, sf).select("student_id", S.heuristic_confidence(
        "final_score", "engagement_score", "consistency_score").alias("confidence"))


_C9 = sc("0.45 * quiz_score + 0.35 * consistency_score + 0.2 * engagement_score", 0, 100)
_C10 = "quiz_score * 0.4 + attendance * 0.3 + assignment_score * 0.3"


@register("c07_spread_confidence", SCORED + f"""SELECT student_id,
  {sc("1.0 - SQRT((((0.0 + (a - m) * (a - m)) + (b - m) * (b - m)) + (c - m) * (c - m)) / 3.0) / 25.0", 0.25, 0.98)} AS confidence
FROM (SELECT student_id, a, b, c, (((0.0 + a) + b) + c) / 3.0 AS m FROM (
  SELECT student_id, CAST(final_score AS DOUBLE) a, CAST({_C9} AS DOUBLE) b, CAST({_C10} AS DOUBLE) c FROM sc) x) y""", LV)
def c07(spark, sf):
    df = _feat(spark, sf).select(
        "student_id", F.col("final_score").alias("m1"),
        S.base_score_proxy("quiz_score", "consistency_score", "engagement_score").alias("m2"),
        S.no_model_prediction("quiz_score", "attendance", "assignment_score").alias("m3"))
    return df.select("student_id", S.spread_confidence(["m1", "m2", "m3"]).alias("confidence"))


@register("c08_topic_insight", SCORED + f"""
, cand AS (
  SELECT s.student_id, t.topic, s.subject_weakness, {_C9} AS base_score
  FROM sc s JOIN topics t ON t.subject = s.subject_weakness),
adj AS (
  SELECT *, {sc('''base_score
     + CASE WHEN lower(COALESCE(subject_weakness, '')) <> '' AND strpos(lower(topic), lower(subject_weakness)) > 0 THEN -9.0 ELSE 0.0 END
     + CASE WHEN regexp_matches(lower(topic), 'advanced|calculus|challenge|optimization') THEN -4.0 ELSE 0.0 END
     + CASE WHEN regexp_matches(lower(topic), 'intro|fundamentals|basics|starter') THEN 3.0 ELSE 0.0 END''', 0, 100)} AS topic_predicted_score
  FROM cand)
SELECT student_id, topic, topic_predicted_score, {RISK.format(s='topic_predicted_score')} AS topic_risk_level,
  CASE WHEN topic_predicted_score < 50 THEN 'Predicted low performance in ' || topic || '; prioritize this topic to prevent learning gaps.'
       WHEN topic_predicted_score < 70 THEN 'Moderate predicted performance in ' || topic || '; a focused practice burst can improve mastery.'
       ELSE 'Strong predicted performance in ' || topic || '; use this as momentum-building practice.' END AS topic_reason
FROM adj""", ("learners", "topics"))
def c08(spark, sf):
    f = _feat(spark, sf).withColumn("base_score", S.base_score_proxy("quiz_score", "consistency_score", "engagement_score"))
    t = C.topics(spark, sf)
    pairs = f.join(F.broadcast(t), t.subject == f.subject_weakness).select("student_id", "topic", "subject_weakness", "base_score")
    return S.topic_insight(pairs).select("student_id", "topic", "topic_predicted_score", "topic_risk_level", "topic_reason")


@register("c09_c10_base_scores", SCORED + f"SELECT student_id, {_C9} AS base_score, {_C10} AS fallback_prediction FROM sc", LV)
def c09(spark, sf):
    return _feat(spark, sf).select(
        "student_id", S.base_score_proxy("quiz_score", "consistency_score", "engagement_score").alias("base_score"),
        S.no_model_prediction("quiz_score", "attendance", "assignment_score").alias("fallback_prediction"))


@register("c11_score_history", SCORED + """SELECT student_id, pos, value, streak FROM (
  SELECT student_id, CAST(extracurricular * 3 + 1 AS INT) AS streak,
    UNNEST([0, 1, 2, 3]) AS pos,
    UNNEST([previous_score * 0.85, previous_score * 0.92, CAST(quiz_score AS DOUBLE), CAST(final_score AS DOUBLE)]) AS value
  FROM sc) x""", LV)
def c11(spark, sf):
    df = _feat(spark, sf).select("student_id", S.score_history("previous_score", "quiz_score", "final_score").alias("h"),
                                 S.streak("extracurricular").alias("streak"))
    return df.select("student_id", F.posexplode("h").alias("pos", "value"), "streak").select(
        "student_id", F.col("pos").cast("int").alias("pos"), "value", "streak")


@register("c12_c13_segments", """SELECT student_id,
  CASE WHEN quiz_score > -1 AND quiz_score <= 55 THEN 'struggling' WHEN quiz_score > 55 AND quiz_score <= 75 THEN 'mid'
       WHEN quiz_score > 75 AND quiz_score <= 101 THEN 'fast' END AS quiz_segment,
  CASE WHEN n - 1 < 2 THEN 'cold_start' WHEN quiz_score < 55 THEN 'struggling' ELSE 'regular' END AS eval_segment
FROM learners, (SELECT COUNT(*) AS n FROM learners) c""", LV)
def c12(spark, sf):
    df = C.learners(spark, sf)
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    return df.crossJoin(F.broadcast(n)).select(
        "student_id", S.quiz_segment("quiz_score").alias("quiz_segment"),
        S.eval_segment(F.col("__n") - 1, "quiz_score").alias("eval_segment"))


_CARD_SQL = """
WITH cand AS (
  SELECT l.student_id, l.quiz_score, l.subject_weakness, t.topic,
         CAST(ROW_NUMBER() OVER (PARTITION BY l.student_id
              ORDER BY CASE WHEN l.quiz_score >= 70 THEN -t.rnk ELSE t.rnk END) - 1 AS INT) AS idx
  FROM learners l JOIN topics t ON t.subject = l.subject_weakness),
adj AS (SELECT *, GREATEST(0.0, LEAST(100.0, quiz_score + (idx * 2 - 3))) AS a FROM cand)
SELECT student_id, topic, idx,
  regexp_replace(lower(topic), '[^a-z0-9]+', '-', 'g') AS card_id,
  CASE WHEN a >= 0 AND a <= 45 THEN 'Starter' WHEN a >= 46 AND a <= 70 THEN 'Guided'
       WHEN a >= 71 AND a <= 100 THEN 'Challenge' ELSE 'Guided' END AS difficulty,
  GREATEST(0.0, LEAST(100.0, quiz_score - 4 + idx * 1.5)) AS card_score,
  CAST(8 + (idx % 4 + 1) * 4 AS INT) AS minutes,
  CAST(10 + (idx % 4) * 5 AS INT) AS minutes_store,
  CAST(list_sum(list_transform(string_split(topic, ''), lambda x: CAST(ascii(x) AS BIGINT))) % 3 AS INT) AS reason_idx
FROM adj"""


@register("c14_c16_recommendation_cards", _CARD_SQL, ("learners", "topics"))
def c14(spark, sf):
    cand = content_candidates(C.learners(spark, sf), C.topics(spark, sf), max_candidates=None)
    idx = (F.col("rnk") - 1).cast("int")
    df = cand.select("student_id", "quiz_score", "topic", idx.alias("idx"))
    return df.select(
        "student_id", "topic", "idx", S.slug("topic").alias("card_id"),
        S.difficulty_label("quiz_score", F.col("idx") * 2 - 3).alias("difficulty"),
        S.card_fallback_score("quiz_score", "idx").alias("card_score"),
        S.card_minutes("idx").alias("minutes"), S.card_minutes_store("idx").alias("minutes_store"),
        S.reason_index("topic").alias("reason_idx"))


@register("c17_insight_sentence", SCORED + f"""
, t AS (SELECT student_id, {RISK.format(s='final_score')} AS risk, CAST(FLOOR(final_score * 10 + 0.5) AS BIGINT) AS d FROM sc)
SELECT student_id, risk, CASE
  WHEN risk = 'high' THEN 'You are currently at risk. Focus on weak concepts and daily practice to lift your forecasted score of ' || CAST(d // 10 AS VARCHAR) || '.' || CAST(d % 10 AS VARCHAR) || '.'
  WHEN risk = 'medium' THEN 'You are on track with room to improve. Consistent effort can push your forecasted score above ' || CAST(d // 10 AS VARCHAR) || '.' || CAST(d % 10 AS VARCHAR) || '.'
  ELSE 'Strong momentum detected. Keep reinforcing your strengths to maintain a forecasted score around ' || CAST(d // 10 AS VARCHAR) || '.' || CAST(d % 10 AS VARCHAR) || '.' END AS insight
FROM t""", LV)
def c17(spark, sf):
    df = _feat(spark, sf).withColumn("risk", S.risk_level("final_score"))
    return df.select("student_id", "risk", S.insight_sentence("final_score", "risk").alias("insight"))


@register("c18_difficulty_adjusted_quiz", """SELECT student_id,
  LEAST(quiz_score * CASE stress_level WHEN 'Low' THEN 0.85 WHEN 'Medium' THEN 1.0 WHEN 'High' THEN 1.15 END, 100.0) AS adjusted_quiz
FROM learners""", LV)
def c18(spark, sf):
    lvl = F.when(F.col("stress_level") == "Low", "Easy").when(F.col("stress_level") == "Medium", "Medium") \
        .when(F.col("stress_level") == "High", "Hard")
    return C.learners(spark, sf).select("student_id", S.difficulty_adjusted_quiz("quiz_score", lvl).alias("adjusted_quiz"))


@register("c19_c20_post_lesson_update", f"""
WITH {FEAT_CTE.strip()},
ev AS (
  SELECT user_id, MAX(CASE WHEN event_type = 'lesson_completed' THEN 1 ELSE 0 END) = 1 AS completed,
         CAST(SUM(CASE WHEN event_type = 'lesson_started' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS elapsed_seconds
  FROM feedback_events GROUP BY user_id)
SELECT student_id,
  LEAST(100.0, COALESCE(engagement_score, 50.0) + 2) AS new_engagement_score,
  LEAST(100.0, COALESCE(consistency_score, 60.0) + CASE WHEN COALESCE(completed, false) THEN 2.0 ELSE 0.0 END) AS new_consistency_score,
  GREATEST(0.0, LEAST(100.0, COALESCE(previous_score, 60.0) + CASE WHEN COALESCE(completed, false) THEN 1.5 ELSE 0.0 END)) AS new_previous_score,
  GREATEST(0.1, LEAST(24.0, COALESCE(time_spent_hours, 1.0) + COALESCE(elapsed_seconds, 0) / 3600)) AS new_time_spent_hours,
  CASE WHEN COALESCE(elapsed_seconds, 0) < 30 THEN 'Warm-up phase: skim the key concept.'
       WHEN COALESCE(elapsed_seconds, 0) < 90 THEN 'Deep focus: connect examples with prior lessons.'
       ELSE 'Mastery mode: summarize this concept in your own words.' END AS study_phase
FROM feat LEFT JOIN ev ON student_id = user_id""", ("learners", "feedback_events"))
def c19(spark, sf):
    ev = C.events(spark, sf).groupBy("user_id").agg(
        (F.max(F.when(F.col("event_type") == "lesson_completed", 1).otherwise(0)) == 1).alias("completed"),
        F.sum(F.when(F.col("event_type") == "lesson_started", F.col("value").cast("decimal(18,2)"))
              .otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double").alias("elapsed_seconds"))
    f = C.features(spark, sf).join(ev, F.col("student_id") == F.col("user_id"), "left")
    out = S.post_lesson_update(f)
    return out.select("student_id", "new_engagement_score", "new_consistency_score", "new_previous_score",
                      "new_time_spent_hours",
                      S.study_phase(F.coalesce(F.col("elapsed_seconds"), F.lit(0.0))).alias("study_phase"))


_RATED = """(SELECT event_id, CASE WHEN event_type = 'error' THEN 'rating_submitted' ELSE event_type END AS event_type,
   CASE WHEN event_type = 'error' THEN 1 + event_id % 5 END AS rating FROM feedback_events)"""


def _rated(spark, sf):
    e = C.events(spark, sf)
    err = F.col("event_type") == "error"
    return e.select("event_id", "user_id", "topic_idx", "timestamp_utc", "session_id",
                    F.when(err, "rating_submitted").otherwise(F.col("event_type")).alias("event_type"),
                    F.when(err, F.col("event_id") % 5 + 1).alias("rating"))


@register("c21_c22_event_reward_weight", f"""SELECT event_id,
  CASE WHEN event_type = 'rating_submitted' THEN {sc('COALESCE(CAST(rating AS DOUBLE), 3.0) / 5.0', 0.0, 1.5)}
       WHEN event_type = 'recommendation_clicked' THEN 1.0 WHEN event_type = 'lesson_completed' THEN 1.25
       WHEN event_type = 'lesson_started' THEN 0.35 WHEN event_type = 'recommendation_shown' THEN 0.05 ELSE 0.0 END AS reward,
  CASE event_type WHEN 'recommendation_clicked' THEN 2.0 WHEN 'lesson_completed' THEN 2.5 WHEN 'rating_submitted' THEN 1.5
       WHEN 'lesson_started' THEN 0.8 WHEN 'recommendation_shown' THEN 0.5 ELSE 1.0 END AS interaction_weight
FROM {_RATED} r""", ("feedback_events",))
def c21(spark, sf):
    r = _rated(spark, sf)
    return r.select("event_id", S.event_reward("event_type", "rating").alias("reward"),
                    S.interaction_weight("event_type").alias("interaction_weight"))


@register("c23_hashed_vector", """SELECT topic, CAST(i AS INT) AS pos,
  CAST(('0x' || substr(sha256(topic), 2 * i + 1, 2))::INTEGER AS DOUBLE) / 255.0 AS value
FROM topics, range(9) r(i)""", ("topics",))
def c23(spark, sf):
    t = C.topics(spark, sf).select("topic", S.hashed_vector("topic").alias("v"))
    return t.select("topic", F.posexplode("v").alias("pos", "value")).select(
        "topic", F.col("pos").cast("int").alias("pos"), "value")


@register("c24_ab_bucket", """SELECT student_id,
  CAST(('0x' || substr(md5('reco_v3:' || CAST(student_id AS VARCHAR)), 1, 8))::BIGINT % 100 AS INT) AS bucket_num,
  CASE WHEN ('0x' || substr(md5('reco_v3:' || CAST(student_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 50
       THEN 'treatment' ELSE 'control' END AS bucket
FROM learners""", LV)
def c24(spark, sf):
    return C.learners(spark, sf).select("student_id", S.ab_bucket_number("student_id", "reco_v3").alias("bucket_num"),
                                        S.ab_bucket("student_id", "reco_v3", 50).alias("bucket"))


@register("c25_idempotency_key", """SELECT event_id, sha256(to_json({
    'event_type': event_type, 'item_id': CAST(topic_idx AS VARCHAR), 'payload': '{}',
    'session_id': session_id, 'timestamp_utc': strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S.%f'),
    'user_id': CAST(user_id AS VARCHAR)})) AS idempotency_key
FROM feedback_events""", ("feedback_events",))
def c25(spark, sf):
    e = C.events(spark, sf).withColumn("explicit_key", F.lit(None).cast("string"))
    return e.select("event_id", S.idempotency_key(
        "explicit_key", event_type="event_type", user="user_id", item=F.col("topic_idx").cast("string"),
        session="session_id", ts="timestamp_utc", payload=F.lit("{}")).alias("idempotency_key"))


@register("c26_request_fingerprint", """SELECT student_id, 'recommend:' || md5(to_json({
    'attempts': attempts, 'quiz_score': CAST(CAST(quiz_score AS DECIMAL(12,4)) AS VARCHAR),
    'subject_weakness': subject_weakness})) AS fingerprint
FROM learners""", LV)
def c26(spark, sf):
    df = C.learners(spark, sf).select("student_id", "attempts", "subject_weakness",
                                      F.col("quiz_score").cast("decimal(12,4)").cast("string").alias("q"))
    return df.select("student_id", S.request_fingerprint(
        "recommend", {"attempts": "attempts", "quiz_score": "q", "subject_weakness": "subject_weakness"}).alias("fingerprint"))


@register("c27_short_form_profile", f"""WITH {FEAT_CTE.strip()}
SELECT student_id, consistency_score AS attendance, (consistency_score + quiz_score) / 2 AS assignment_score,
  engagement_score / 10 AS time_spent_hours, 0.8 * quiz_score + 0.2 * consistency_score AS previous_score,
  20 AS age, 'Male' AS gender, 'Visual' AS learning_style, 1 AS internet_access, 'Medium' AS parental_support,
  0 AS extracurricular, 'Medium' AS stress_level
FROM feat""", LV)
def c27(spark, sf):
    df = C.features(spark, sf).select("student_id", "quiz_score", "engagement_score", "consistency_score")
    return S.short_form_profile(df).drop("quiz_score", "engagement_score", "consistency_score")

"""Registered queries: sources, contracts, cleaning and features (A, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathwise.functions import constants as K
from pathwise.functions.expressions import scaled
from pathwise.operators import features as FT
from pathwise.operators import contracts as CT
from pathwise.plans import common as C
from pathwise.plans.catalog import register
from pathwise.plans.sqlparts import FEAT_CTE, clip as sq_clip, scaled as sq_scaled

LV = ("learners",)
TRAIN_SQL = "CAST(('x' || substr(md5('42:' || CAST({k} AS VARCHAR)), 1, 8))::BIT::BIGINT % 100 < 80 AS BOOLEAN)"


def _train_sql(k: str) -> str:
    # int(md5('42:'||k)[:8], 16) % 100 < 80 ; the hex prefix fits in BIGINT
    return f"(('0x' || substr(md5('42:' || CAST({k} AS VARCHAR)), 1, 8))::BIGINT % 100 < 80)"


# ----------------------------------------------------------------- A: sources
@register("a01_learners", "SELECT * FROM learners", LV)
def a01(spark, sf):
    return C.learners(spark, sf)


@register("a07_event_log", "SELECT * FROM feedback_events", ("feedback_events",))
def a07(spark, sf):
    return C.events(spark, sf)


# ------------------------------------------------------------ B: cleaning
NULL_NUM = ["attendance", "quiz_score", "time_spent_hours", "previous_score"]


@register("b01_median_impute", """
WITH src AS (
  SELECT student_id,
    CASE WHEN student_id % 7 = 0 THEN NULL ELSE attendance END AS attendance,
    CASE WHEN student_id % 7 = 0 THEN NULL ELSE quiz_score END AS quiz_score,
    CASE WHEN student_id % 7 = 0 THEN NULL ELSE time_spent_hours END AS time_spent_hours,
    CASE WHEN student_id % 7 = 0 THEN NULL ELSE previous_score END AS previous_score,
    attempts
  FROM learners),
m AS (SELECT median(attendance) a, median(quiz_score) q, median(time_spent_hours) h,
             median(previous_score) p, median(attempts) n FROM src)
SELECT student_id, COALESCE(attendance, a) AS attendance, COALESCE(quiz_score, q) AS quiz_score,
       COALESCE(time_spent_hours, h) AS time_spent_hours, COALESCE(previous_score, p) AS previous_score,
       COALESCE(attempts, CAST(n AS INT)) AS attempts
FROM src, m""", LV)
def b01(spark, sf):
    df = C.with_nulls(C.learners(spark, sf), NULL_NUM).select("student_id", *NULL_NUM, "attempts")
    return FT.impute_median(df, NULL_NUM + ["attempts"])


@register("b02_mode_impute", """
WITH src AS (
  SELECT student_id,
    CASE WHEN student_id % 7 = 0 THEN NULL ELSE gender END AS gender,
    CASE WHEN student_id % 7 = 0 THEN NULL ELSE parental_support END AS parental_support,
    CASE WHEN student_id % 7 = 0 THEN NULL ELSE subject_weakness END AS subject_weakness,
    CAST(NULL AS VARCHAR) AS empty_col
  FROM learners),
cnt AS (
  SELECT 'gender' c, gender v, COUNT(*) n FROM src WHERE gender IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'parental_support', parental_support, COUNT(*) FROM src WHERE parental_support IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'subject_weakness', subject_weakness, COUNT(*) FROM src WHERE subject_weakness IS NOT NULL GROUP BY 2),
best AS (SELECT c, v FROM (SELECT c, v, ROW_NUMBER() OVER (PARTITION BY c ORDER BY n DESC, v) r FROM cnt) WHERE r = 1)
SELECT student_id,
  COALESCE(gender, (SELECT v FROM best WHERE c = 'gender'), 'Unknown') AS gender,
  COALESCE(parental_support, (SELECT v FROM best WHERE c = 'parental_support'), 'Unknown') AS parental_support,
  COALESCE(subject_weakness, (SELECT v FROM best WHERE c = 'subject_weakness'), 'Unknown') AS subject_weakness,
  COALESCE(empty_col, 'Unknown') AS empty_col
FROM src""", LV)
def b02(spark, sf):
    cols = ["gender", "parental_support", "subject_weakness"]
    df = (C.with_nulls(C.learners(spark, sf), cols).select("student_id", *cols)
          .withColumn("empty_col", F.lit(None).cast("string")))
    return FT.impute_mode(df, cols + ["empty_col"])


_FEATURE_IDS = [
    ("b03_engagement", ["engagement_score"]),
    ("b04_consistency", ["consistency_score"]),
    ("b05_efficiency", ["learning_efficiency"]),
    ("b06_interactions", ["interaction_attendance_assignment", "interaction_quiz_attempts"]),
    ("b07_difficulty_stability", ["difficulty_adjusted_score", "score_stability"]),
    ("b08_history", ["history_prev_quiz_gap", "rolling_quiz_proxy"]),
    ("b09_recency_frequency", ["recency_proxy", "frequency_proxy"]),
    ("b10_velocity_momentum", ["study_velocity", "trend_momentum"]),
    ("b11_behavior_embeddings", ["behavior_embedding_1", "behavior_embedding_2", "behavior_embedding_3"]),
]


def _feature_query(name, cols):
    sql = f"WITH {FEAT_CTE.strip()}\nSELECT student_id, {', '.join(cols)} FROM feat"

    @register(name, sql, LV)
    def q(spark, sf):
        return FT.engineer_features(C.learners(spark, sf)).select("student_id", *cols)
    return q


for _n, _c in _FEATURE_IDS:
    _feature_query(_n, _c)


@register("b12_feature_contract", f"""
WITH {FEAT_CTE.strip()}
SELECT student_id, {', '.join(K.NUMERIC_FEATURES + K.CATEGORICAL_COLS)} FROM feat""", LV)
def b12(spark, sf):
    df = FT.engineer_features(C.learners(spark, sf))
    cols = FT.feature_contract(df.columns)      # B13 guard runs here
    return df.select("student_id", *cols)


@register("b14_label_encoder_fit", """
WITH u AS (
  SELECT DISTINCT 'gender' AS "column", CAST(gender AS VARCHAR) AS value FROM learners WHERE gender IS NOT NULL
  UNION SELECT DISTINCT 'learning_style', learning_style FROM learners WHERE learning_style IS NOT NULL
  UNION SELECT DISTINCT 'parental_support', parental_support FROM learners WHERE parental_support IS NOT NULL
  UNION SELECT DISTINCT 'stress_level', stress_level FROM learners WHERE stress_level IS NOT NULL)
SELECT "column", value, CAST(ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY value) - 1 AS INT) AS idx FROM u""", LV)
def b14(spark, sf):
    return FT.fit_label_encoder(C.learners(spark, sf), K.CATEGORICAL_COLS)


@register("b15_label_encoder_apply", f"""
WITH tr AS (SELECT * FROM learners WHERE {_train_sql('student_id')}),
enc AS (
  SELECT c, v, CAST(ROW_NUMBER() OVER (PARTITION BY c ORDER BY v) - 1 AS INT) AS i FROM (
    SELECT DISTINCT 'learning_style' AS c, learning_style AS v FROM tr WHERE learning_style IS NOT NULL
    UNION SELECT DISTINCT 'subject_weakness', subject_weakness FROM tr WHERE subject_weakness IS NOT NULL) u)
SELECT student_id,
  COALESCE((SELECT i FROM enc WHERE c = 'learning_style' AND v = learning_style), 0) AS learning_style,
  COALESCE((SELECT i FROM enc WHERE c = 'subject_weakness' AND v = subject_weakness), 0) AS subject_weakness
FROM learners""", LV)
def b15(spark, sf):
    df = C.learners(spark, sf)
    cols = ["learning_style", "subject_weakness"]
    enc = FT.fit_label_encoder(df.filter(C.train_flag("student_id")), cols)
    return FT.apply_label_encoder(df, enc, cols).select("student_id", *cols)


_STD_COLS = ["quiz_score", "engagement_score", "behavior_embedding_2", "attempts"]


@register("b16_standardize", f"""
WITH {FEAT_CTE.strip()},
p AS (SELECT {', '.join(f"avg({c}) AS mu_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS sd_{c}" for c in _STD_COLS)} FROM feat)
SELECT student_id, {', '.join(sq_scaled(f"({c} - mu_{c}) / sd_{c}") + f" AS {c}" for c in _STD_COLS)}
FROM feat, p""", LV)
def b16(spark, sf):
    df = FT.standardize(FT.engineer_features(C.learners(spark, sf)).select("student_id", *_STD_COLS), _STD_COLS)
    return df.select("student_id", *[scaled(c).alias(c) for c in _STD_COLS])


@register("b17_one_hot", f"""
WITH cats AS (SELECT DISTINCT learning_style AS cat FROM learners WHERE {_train_sql('student_id')} AND learning_style IS NOT NULL)
SELECT student_id, cat AS category, CASE WHEN learning_style = cat THEN 1.0 ELSE 0.0 END AS learning_style_onehot
FROM learners, cats""", LV)
def b17(spark, sf):
    df = C.learners(spark, sf)
    cats = FT.fit_label_encoder(df.filter(C.train_flag("student_id")), ["learning_style"])
    return (FT.one_hot(df.select("student_id", "learning_style"), "learning_style", cats)
            .select("student_id", F.col("__cat").alias("category"), "learning_style_onehot"))


_B18_NUM = ["attendance", "assignment_score", "quiz_score", "time_spent_hours", "attempts", "previous_score"]


@register("b18_column_preprocessor", f"""WITH d AS (
  SELECT student_id, learning_style, {', '.join(c for c in _B18_NUM if c != 'quiz_score')},
    CASE WHEN student_id % 7 = 0 THEN NULL ELSE quiz_score END AS quiz_score FROM learners),
m AS (SELECT {', '.join(f'median({c}) AS md_{c}' for c in _B18_NUM)}, mode(learning_style) AS md_style FROM d),
f AS (SELECT student_id, COALESCE(learning_style, md_style, 'Unknown') AS learning_style,
        {', '.join(f"CAST(COALESCE({c}, {'CAST(md_' + c + ' AS INT)' if c == 'attempts' else 'md_' + c}) AS DOUBLE) AS {c}" for c in _B18_NUM)} FROM d, m),
p AS (SELECT {', '.join(f'avg({c}) AS mu_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS sd_{c}' for c in _B18_NUM)} FROM f),
k AS (SELECT DISTINCT learning_style AS category FROM f)
SELECT student_id, {', '.join(sq_scaled(f"({c} - mu_{c}) / sd_{c}") + f" AS {c}" for c in _B18_NUM)}, learning_style, category,
  CASE WHEN learning_style = category THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS learning_style_onehot
FROM f, p, k""", LV)
def b18(spark, sf):
    df = C.with_nulls(C.learners(spark, sf), ["quiz_score", "gender"])
    clean = FT.handle_missing(df, _B18_NUM, ["gender", "learning_style"])
    scaled_df = FT.standardize(clean, _B18_NUM)
    cats = FT.fit_label_encoder(clean, ["learning_style"])
    r = FT.one_hot(scaled_df.select("student_id", *_B18_NUM, "learning_style"), "learning_style", cats)
    return r.select("student_id", *[scaled(c).alias(c) for c in _B18_NUM], "learning_style",
                    F.col("__cat").alias("category"), "learning_style_onehot")


_B19_NUM = K.NUMERIC_FEATURES


@register("b19_preprocess", f"""
WITH {FEAT_CTE.strip()},
enc AS (
  SELECT c, v, CAST(ROW_NUMBER() OVER (PARTITION BY c ORDER BY v) - 1 AS INT) AS i FROM (
    SELECT DISTINCT 'gender' AS c, gender AS v FROM feat
    UNION SELECT DISTINCT 'learning_style', learning_style FROM feat
    UNION SELECT DISTINCT 'parental_support', parental_support FROM feat
    UNION SELECT DISTINCT 'stress_level', stress_level FROM feat) u WHERE v IS NOT NULL),
p AS (SELECT {', '.join(f"avg({c}) AS mu_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS sd_{c}" for c in _B19_NUM)} FROM feat)
SELECT student_id,
  {', '.join(sq_scaled(f"({c} - mu_{c}) / sd_{c}") + f" AS {c}" for c in _B19_NUM)},
  {', '.join(f"COALESCE((SELECT i FROM enc WHERE c = '{c}' AND v = {c}), 0) AS {c}" for c in K.CATEGORICAL_COLS)}
FROM feat, p""", LV)
def b19(spark, sf):
    out, _, _ = FT.preprocess(C.learners(spark, sf))
    return out.select("student_id", *[scaled(c).alias(c) for c in _B19_NUM], *K.CATEGORICAL_COLS)


@register("b20_drop_null_target", f"""
WITH {FEAT_CTE.strip()}
SELECT student_id, CAST(final_score AS DOUBLE) AS final_score FROM (
  SELECT student_id, CASE WHEN student_id % 7 = 0 THEN NULL ELSE
    {sq_clip('0.30 * quiz_score + 0.20 * assignment_score + 0.15 * attendance + 0.15 * consistency_score + 0.10 * previous_score + 0.05 * engagement_score + 0.05 * learning_efficiency', 10, 100)}
    END AS final_score FROM feat) x
WHERE final_score IS NOT NULL""", LV)
def b20(spark, sf):
    df = C.with_nulls(C.features(spark, sf).select("student_id", "final_score"), ["final_score"])
    return FT.drop_null_target(df)


@register("b21_composite_score", f"""
WITH {FEAT_CTE.strip()}
SELECT student_id, {sq_clip('0.30 * quiz_score + 0.20 * assignment_score + 0.15 * attendance + 0.15 * consistency_score + 0.10 * previous_score + 0.05 * engagement_score + 0.05 * learning_efficiency', 10, 100)} AS final_score
FROM feat""", LV)
def b21(spark, sf):
    return C.features(spark, sf).select("student_id", "final_score")


@register("b22_strength_weakness_repair", """
WITH subj AS (SELECT DISTINCT subject FROM topics)
SELECT student_id, subject_strength,
  CASE WHEN subject_strength = subject_weakness
       THEN (SELECT MIN(subject) FROM subj WHERE subject <> subject_strength)
       ELSE subject_weakness END AS subject_weakness
FROM learners""", ("learners", "topics"))
def b22(spark, sf):
    df = C.learners(spark, sf).select("student_id", "subject_strength", "subject_weakness")
    return FT.repair_strength_weakness(df, C.topics(spark, sf))

"""Fixed values the engine's results depend on.

These are behavioural constants (thresholds, weights, word lists, enum
values) of the learner-analytics model.  They are kept together here, in
natural order, so every operator reads them from one place.
"""

# --- fixed values: schema ---------------------------------------------------
SCHEMA_VERSION = "2.0"
TARGET = "final_score"
REQUIRED_COLUMNS = [
    "age", "gender", "learning_style", "attendance", "assignment_score",
    "quiz_score", "time_spent_hours", "attempts", "previous_score",
    "internet_access", "parental_support", "extracurricular", "stress_level",
]
CATEGORICAL_COLS = ["gender", "learning_style", "parental_support", "stress_level"]
NUMERIC_FEATURES = [
    "age", "attendance", "assignment_score", "quiz_score", "time_spent_hours",
    "attempts", "previous_score", "internet_access", "extracurricular",
    "engagement_score", "consistency_score", "learning_efficiency",
    "interaction_attendance_assignment", "interaction_quiz_attempts",
    "difficulty_adjusted_score", "score_stability", "history_prev_quiz_gap",
    "rolling_quiz_proxy", "recency_proxy", "frequency_proxy", "study_velocity",
    "trend_momentum", "behavior_embedding_1", "behavior_embedding_2",
    "behavior_embedding_3",
]
LEAKAGE_PATTERNS = ["target", "label", "future", "post", "final_score"]

# --- fixed values: neighbour features ---------------------------------------
RICH_FEATURES = [
    "quiz_score", "engagement_score", "consistency_score", "attempts",
    "previous_score", "time_spent_hours", "attendance", "assignment_score",
    "learning_efficiency", "score_stability", "trend_momentum",
    "behavior_embedding_1", "behavior_embedding_2", "behavior_embedding_3",
]
CAT_FEATURES = ["gender", "learning_style", "parental_support", "stress_level",
                "subject_strength", "subject_weakness"]

# --- fixed values: feedback events ------------------------------------------
EVENT_TYPES = ["recommendation_shown", "recommendation_clicked", "lesson_started",
               "lesson_completed", "rating_submitted"]
# reward per event type (rating events use the clipped rating instead)
EVENT_REWARD = {"recommendation_clicked": 1.0, "lesson_completed": 1.25,
                "lesson_started": 0.35, "recommendation_shown": 0.05}
DEFAULT_RATING = 3.0
# implicit-feedback weight per event type, default 1.0
EVENT_WEIGHT = {"recommendation_clicked": 2.0, "lesson_completed": 2.5,
                "rating_submitted": 1.5, "lesson_started": 0.8,
                "recommendation_shown": 0.5}
ONLINE_TTL_SECONDS = 7200

# --- fixed values: topic insight tokens --------------------------------------
HARD_TOPIC_TOKENS = ["advanced", "calculus", "challenge", "optimization"]
EASY_TOPIC_TOKENS = ["intro", "fundamentals", "basics", "starter"]

# --- fixed values: explanation reasons ---------------------------------------
REASON_LOW_PREDICTED = "low predicted performance"
REASON_LOW_ENGAGEMENT = "low engagement"
REASON_HIGH_ATTEMPTS = "high attempts"
REASON_INCONSISTENT = "inconsistent performance"
REASON_STRONG = "strong overall performance"
EXPLANATION_PREFIX = "This student shows "

# --- fixed values: per-topic insight sentences -------------------------------
INSIGHT_HIGH = "Predicted low performance in {t}; prioritize this topic to prevent learning gaps."
INSIGHT_MEDIUM = "Moderate predicted performance in {t}; a focused practice burst can improve mastery."
INSIGHT_LOW = "Strong predicted performance in {t}; use this as momentum-building practice."

# --- fixed values: ranking weights -------------------------------------------
# similarity, recency, popularity, completion, ctr, freshness, difficulty,
# 1/distinct words, 1/rank
RANK_WEIGHTS = [0.28, 0.18, 0.14, 0.14, 0.08, 0.08, 0.06, 0.04, 0.02]

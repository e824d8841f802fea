"""Reusable oracle SQL fragments (DuckDB dialect, ANSI where possible)."""


def clip(expr: str, lo, hi) -> str:
    e = f"({expr})"
    return f"(CASE WHEN {e} < {lo} THEN {lo} WHEN {e} > {hi} THEN {hi} ELSE {e} END)"


def scaled(expr: str, digits: int = 6) -> str:
    return f"CAST(FLOOR(({expr}) * {10.0 ** digits} + 0.5) AS BIGINT)"


# learners + engineered features (B3-B11), written with CASE clips
_eng = clip("time_spent_hours * 10 + attempts * 5", 0, 100)
_con = clip("(attendance + assignment_score) / 2", 0, 100)
_eff = clip("quiz_score / (time_spent_hours + 0.1)", 0, 200)
FEAT_CTE = f"""
feat0 AS (
  SELECT *,
    {_eng} AS engagement_score,
    {_con} AS consistency_score,
    {_eff} AS learning_efficiency,
    attendance * assignment_score / 100.0 AS interaction_attendance_assignment,
    quiz_score / (attempts + 1.0) AS interaction_quiz_attempts,
    quiz_score - 0.15 * (100.0 - {clip('previous_score', 0, 100)}) AS difficulty_adjusted_score,
    100.0 - ABS(quiz_score - previous_score) AS score_stability,
    quiz_score - previous_score AS history_prev_quiz_gap,
    0.6 * quiz_score + 0.4 * previous_score AS rolling_quiz_proxy,
    {clip('100.0 - (time_spent_hours * 4.0 + attempts * 3.0)', 0, 100)} AS recency_proxy,
    {clip('attempts / (time_spent_hours + 0.1)', 0, 20)} AS frequency_proxy,
    quiz_score / (time_spent_hours + 0.1) AS study_velocity
  FROM learners),
feat1 AS (
  SELECT *, {clip('quiz_score - previous_score + learning_efficiency * 0.05', -100, 100)} AS trend_momentum
  FROM feat0),
feat AS (
  SELECT *,
    {clip('0.45 * engagement_score + 0.35 * consistency_score + 0.20 * learning_efficiency', 0, 200)} AS behavior_embedding_1,
    {clip('0.50 * quiz_score + 0.30 * previous_score + 0.20 * trend_momentum', 0, 200)} AS behavior_embedding_2,
    {clip('0.55 * attendance + 0.45 * assignment_score', 0, 100)} AS behavior_embedding_3
  FROM feat1)
"""

RISK = ("CASE WHEN {s} < 50 THEN 'high' WHEN {s} < 70 THEN 'medium' ELSE 'low' END")

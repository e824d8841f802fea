"""Scoring, banding, explanation and hashing projections.

All are column expressions: they run inside whole-stage codegen on the
rows they annotate and never shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathwise.functions import constants as K
from pathwise.functions.expressions import case_map, clip, col, contains_any, hex_byte


# ------------------------------------------------------------------- bands
def risk_level(score, upper_inclusive: bool = False) -> Column:
    """C1 (<50 high, <70 medium, else low); C2 with ``upper_inclusive`` (<=70 medium)."""
    s = col(score)
    med = (s <= 70) if upper_inclusive else (s < 70)
    return F.when(s < 50, "high").when(med, "medium").otherwise("low")


def learner_class(predicted, engagement) -> Column:
    """Fast / Struggling / Low Engagement."""
    p, e = col(predicted), col(engagement)
    return (F.when((p >= 75) & (e >= 60), "Fast Learner")
            .when((p < 55) | (e < 35), "Struggling Learner")
            .otherwise("Low Engagement"))


def explanation(predicted, engagement, attempts, consistency) -> Column:
    """C4: sentence built from up to four reasons."""
    reasons = F.array_compact(F.array(
        F.when(col(predicted) < 55, K.REASON_LOW_PREDICTED),
        F.when(col(engagement) < 35, K.REASON_LOW_ENGAGEMENT),
        F.when(col(attempts) > 6, K.REASON_HIGH_ATTEMPTS),
        F.when(col(consistency) < 50, K.REASON_INCONSISTENT)))
    txt = F.when(F.size(reasons) == 0, F.lit(K.REASON_STRONG)).otherwise(F.array_join(reasons, ", "))
    return F.concat(F.lit(K.EXPLANATION_PREFIX), txt, F.lit("."))


def weak_areas(quiz, attendance, assignment, subject) -> Column:
    """C5 (prediction variant): array of weak areas, ['None'] when empty."""
    arr = F.array_compact(F.array(
        F.when(col(quiz) < 60, F.coalesce(col(subject), F.lit("General Studies"))),
        F.when(col(attendance) < 60, F.lit("Attendance / Consistency")),
        F.when(col(assignment) < 55, F.lit("Assignment Completion"))))
    return F.when(F.size(arr) == 0, F.array(F.lit("None"))).otherwise(arr)


def weak_areas_profile(quiz, attendance, subject) -> Column:
    """C5 (profile variant): no assignment rule and no 'None' filler."""
    return F.array_compact(F.array(
        F.when(col(quiz) < 60, F.coalesce(col(subject), F.lit("General"))),
        F.when(col(attendance) < 60, F.lit("Attendance"))))


def heuristic_confidence(predicted, engagement, consistency) -> Column:
    """0.35 + 0.3*distance + 0.35*behaviour, clipped to [0.25, 0.95]."""
    dist = F.least(F.lit(1.0), F.abs(col(predicted) - 50.0) / 50.0)
    beh = clip((col(engagement) + col(consistency)) / 200.0, 0.0, 1.0)
    return clip(F.lit(0.35) + F.lit(0.3) * dist + F.lit(0.35) * beh, 0.25, 0.95)


def spread_confidence(member_cols: list[str]) -> Column:
    """1 - popstd(member predictions)/25, clipped to [0.25, 0.98]."""
    arr = F.array(*[col(c).cast("double") for c in member_cols])
    n = F.lit(float(len(member_cols)))
    mean = F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / n
    var = F.aggregate(arr, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean)) / n
    return clip(F.lit(1.0) - F.sqrt(var) / 25.0, 0.25, 0.98)


def topic_insight(df: DataFrame, base="base_score", topic="topic", weak="subject_weakness") -> DataFrame:
    """Per-topic predicted score, risk band and reason sentence."""
    t = F.lower(col(topic))
    w = F.lower(F.coalesce(col(weak), F.lit("")))
    adj = (F.when((w != "") & (F.instr(t, w) > 0), -9.0).otherwise(0.0)
           + F.when(contains_any(t, K.HARD_TOPIC_TOKENS), -4.0).otherwise(0.0)
           + F.when(contains_any(t, K.EASY_TOPIC_TOKENS), 3.0).otherwise(0.0))
    pred = clip(col(base) + adj, 0, 100)
    df = df.withColumn("topic_predicted_score", pred)
    rl = risk_level("topic_predicted_score")
    reason = (F.when(rl == "high", F.replace(F.lit(K.INSIGHT_HIGH), F.lit("{t}"), col(topic)))
              .when(rl == "medium", F.replace(F.lit(K.INSIGHT_MEDIUM), F.lit("{t}"), col(topic)))
              .otherwise(F.replace(F.lit(K.INSIGHT_LOW), F.lit("{t}"), col(topic))))
    return df.withColumn("topic_risk_level", rl).withColumn("topic_reason", reason)


def base_score_proxy(quiz, consistency, engagement) -> Column:
    """0.45 quiz + 0.35 consistency + 0.2 engagement, clip 0..100."""
    return clip(F.lit(0.45) * col(quiz) + F.lit(0.35) * col(consistency)
                + F.lit(0.2) * col(engagement), 0, 100)


def no_model_prediction(quiz, attendance, assignment) -> Column:
    """quiz*0.4 + attendance*0.3 + assignment*0.3."""
    return col(quiz) * 0.4 + col(attendance) * 0.3 + col(assignment) * 0.3


def score_history(previous, quiz, predicted) -> Column:
    """C11: [0.85 prev, 0.92 prev, quiz, predicted]."""
    return F.array(col(previous) * 0.85, col(previous) * 0.92,
                   col(quiz).cast("double"), col(predicted).cast("double"))


def streak(extracurricular) -> Column:
    """C11: 3 * extracurricular + 1."""
    return (col(extracurricular) * 3 + 1).cast("int")


def quiz_segment(quiz) -> Column:
    """Right-closed bins (-1,55] struggling, (55,75] mid, (75,101] fast."""
    q = col(quiz)
    return (F.when((q > -1) & (q <= 55), "struggling").when((q > 55) & (q <= 75), "mid")
            .when((q > 75) & (q <= 101), "fast"))


def eval_segment(n_others, quiz) -> Column:
    """cold_start when fewer than 2 other learners, <55 struggling, else regular."""
    return (F.when(col(n_others) < 2, "cold_start").when(col(quiz) < 55, "struggling")
            .otherwise("regular"))


def difficulty_label(quiz, offset) -> Column:
    """C14: band of clip(quiz+offset,0,100): 0-45 Starter, 46-70 Guided, 71-100 Challenge.

    Values in the gaps (45..46, 70..71) fall back to Guided.
    """
    a = F.greatest(F.lit(0.0), F.least(F.lit(100.0), col(quiz).cast("double") + col(offset)))
    return (F.when((a >= 0) & (a <= 45), "Starter").when((a >= 46) & (a <= 70), "Guided")
            .when((a >= 71) & (a <= 100), "Challenge").otherwise("Guided"))


def slug(topic) -> Column:
    """Lower-case, runs of non [a-z0-9] -> '-'."""
    return F.regexp_replace(F.lower(col(topic)), "[^a-z0-9]+", "-")


def card_fallback_score(quiz, index) -> Column:
    """clip(quiz - 4 + 1.5 * index, 0, 100) (index 0-based)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), col(quiz) - 4 + col(index) * 1.5))


def card_minutes(index) -> Column:
    """8 + 4 * (index % 4 + 1)."""
    return (F.lit(8) + (col(index) % 4 + 1) * 4).cast("int")


def card_minutes_store(index) -> Column:
    """C15 (store variant): 10 + 5 * (index % 4)."""
    return (F.lit(10) + (col(index) % 4) * 5).cast("int")


def reason_index(topic) -> Column:
    """(sum of character codes) mod 3."""
    codes = F.transform(F.split(col(topic), ""), lambda ch: F.ascii(ch).cast("bigint"))
    return (F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, v: a + v) % 3).cast("int")


def reason_text(topic, weakness, skill_level) -> Column:
    """Reason sentence picked by :func:`reason_index`."""
    i = reason_index(topic)
    return (F.when(i == 0, F.concat(F.lit("Because you struggled with "), col(weakness)))
            .when(i == 1, F.lit("Based on your recent activity"))
            .otherwise(F.concat(F.lit("Matched to your "), F.lower(col(skill_level)),
                                F.lit(" learning pace"))))


def insight_sentence(predicted, risk) -> Column:
    """C17: insight sentence by risk, score with one decimal."""
    s = F.format_number(F.coalesce(col(predicted), F.lit(0.0)), 1)
    s = F.regexp_replace(s, ",", "")
    return (F.when(col(risk) == "high", F.concat(
        F.lit("You are currently at risk. Focus on weak concepts and daily practice to lift your forecasted score of "), s, F.lit(".")))
        .when(col(risk) == "medium", F.concat(
            F.lit("You are on track with room to improve. Consistent effort can push your forecasted score above "), s, F.lit(".")))
        .otherwise(F.concat(
            F.lit("Strong momentum detected. Keep reinforcing your strengths to maintain a forecasted score around "), s, F.lit("."))))


DIFFICULTY_FACTOR = {"Easy": 0.85, "Medium": 1.0, "Hard": 1.15}  # fixed values


def difficulty_adjusted_quiz(quiz, level) -> Column:
    """Quiz x {Easy .85, Medium 1.0, Hard 1.15}, capped at 100."""
    return F.least(col(quiz) * case_map(level, DIFFICULTY_FACTOR), F.lit(100.0))


def post_lesson_update(df: DataFrame, completed="completed", elapsed="elapsed_seconds") -> DataFrame:
    """Signal update after a lesson (engagement, consistency, previous, hours)."""
    done = F.coalesce(col(completed), F.lit(False))
    return df.select(
        "*",
        F.least(F.lit(100.0), F.coalesce(F.col("engagement_score"), F.lit(50.0)) + 2).alias("new_engagement_score"),
        F.least(F.lit(100.0), F.coalesce(F.col("consistency_score"), F.lit(60.0))
                + F.when(done, 2.0).otherwise(0.0)).alias("new_consistency_score"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(F.col("previous_score"), F.lit(60.0))
                                       + F.when(done, 1.5).otherwise(0.0))).alias("new_previous_score"),
        F.greatest(F.lit(0.1), F.least(F.lit(24.0), F.coalesce(F.col("time_spent_hours"), F.lit(1.0))
                                       + F.coalesce(col(elapsed), F.lit(0)).cast("double") / 3600)
                   ).alias("new_time_spent_hours"))


def study_phase(elapsed) -> Column:
    """C20: study phase by elapsed seconds (<30 warm-up, <90 deep focus, else mastery)."""
    e = col(elapsed)
    return (F.when(e < 30, "Warm-up phase: skim the key concept.")
            .when(e < 90, "Deep focus: connect examples with prior lessons.")
            .otherwise("Mastery mode: summarize this concept in your own words."))


# ------------------------------------------------------------ event values
def event_reward(event_type, rating=None) -> Column:
    """Reward of an event; ratings are clip(r/5, 0, 1.5) with default 3."""
    et = col(event_type)
    r = F.lit(K.DEFAULT_RATING) if rating is None else F.coalesce(col(rating).cast("double"), F.lit(K.DEFAULT_RATING))
    out = F.when(et == "rating_submitted", clip(r / 5.0, 0.0, 1.5))
    for k, v in K.EVENT_REWARD.items():
        out = out.when(et == k, F.lit(v))
    return out.otherwise(F.lit(0.0))


def interaction_weight(event_type) -> Column:
    """Implicit-feedback weight of an event type (default 1.0)."""
    return case_map(event_type, K.EVENT_WEIGHT, 1.0)


# ----------------------------------------------------------------- hashing
def hashed_vector(key, dim: int = 9) -> Column:
    """First ``dim`` bytes of SHA-256(key) / 255 as array<double>."""
    h = F.sha2(col(key).cast("string"), 256)
    return F.array(*[hex_byte(h, i) / 255.0 for i in range(dim)])


def ab_bucket_number(user, experiment: str) -> Column:
    """int(md5('experiment:user')[:8], 16) % 100."""
    d = F.md5(F.concat(F.lit(f"{experiment}:"), col(user).cast("string")))
    return (F.conv(F.substring(d, 1, 8), 16, 10).cast("bigint") % 100).cast("int")


def ab_bucket(user, experiment: str = "reco_v3", split: int = 50) -> Column:
    """C24: 'treatment' when the bucket number is below the (1..99-clamped) split."""
    s = max(1, min(split, 99))
    return F.when(ab_bucket_number(user, experiment) < s, "treatment").otherwise("control")


def canonical_event_json(event_type="event_type", user="user_id", item="item_id",
                         session="session_id", ts="timestamp_utc", payload="payload") -> Column:
    """Our canonical event JSON: keys sorted, all values strings, NULL kept.

    The timestamp is written as ``yyyy-MM-ddTHH:mm:ss.ffffff`` (UTC) and the
    payload as its (already canonical) JSON text.
    """
    fields = {
        "event_type": col(event_type).cast("string"),
        "item_id": col(item).cast("string"),
        "payload": F.coalesce(col(payload).cast("string"), F.lit("{}")),
        "session_id": col(session).cast("string"),
        "timestamp_utc": F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        "user_id": col(user).cast("string"),
    }
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]),
                     {"ignoreNullFields": "false"})


def idempotency_key(explicit="idempotency_key", **kw) -> Column:
    """Explicit key, else SHA-256 of the canonical event JSON."""
    return F.coalesce(F.nullif(col(explicit), F.lit("")), F.sha2(canonical_event_json(**kw), 256))


def request_fingerprint(namespace: str, fields: dict) -> Column:
    """C26: 'namespace:' + md5 of the request's JSON with keys sorted.

    ``fields`` maps JSON key -> column; NULLs are kept as ``null``.
    """
    st = F.struct(*[col(v).alias(k) for k, v in sorted(fields.items())])
    return F.concat(F.lit(f"{namespace}:"), F.md5(F.to_json(st, {"ignoreNullFields": "false"})))


def short_form_profile(df: DataFrame) -> DataFrame:
    """Derive a full learner profile from (quiz, engagement, consistency, attempts)."""
    q, e, c = F.col("quiz_score"), F.col("engagement_score"), F.col("consistency_score")
    return df.select(
        "*",
        c.alias("attendance"),
        ((c + q) / 2).alias("assignment_score"),
        (e / 10).alias("time_spent_hours"),
        (F.lit(0.8) * q + F.lit(0.2) * c).alias("previous_score"),
        F.lit(20).alias("age"), F.lit("Male").alias("gender"),
        F.lit("Visual").alias("learning_style"),
        F.lit(1).alias("internet_access"), F.lit("Medium").alias("parental_support"),
        F.lit(0).alias("extracurricular"), F.lit("Medium").alias("stress_level"))

"""Registered queries: event aggregates, windows, monitoring and set operations (F1-F11, W, S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathwise.functions import constants as K
from pathwise.functions.expressions import scaled
from pathwise.operators import events as EV
from pathwise.operators import monitoring as MO
from pathwise.operators import scoring as S
from pathwise.plans import common as C
from pathwise.plans.catalog import register
from pathwise.plans.sqlparts import FEAT_CTE, clip as sc, scaled as sq

TE = ("topics", "feedback_events")
EVS = C.RATED_EVENTS_SQL
AS_OF = "2024-01-20 00:00:00"


def _ev(spark, sf):
    return C.rated_events(spark, sf)


# ------------------------------------------------------------------ F1-F6
@register("f01_user_snapshot", f"""WITH {EVS}
SELECT user_id, CAST(COUNT(*) AS BIGINT) AS interactions,
  CAST(SUM(CASE WHEN event_type = 'recommendation_clicked' THEN 1 ELSE 0 END) AS BIGINT) AS clicks,
  CAST(SUM(CASE WHEN event_type = 'lesson_completed' THEN 1 ELSE 0 END) AS BIGINT) AS completions,
  MAX(timestamp_utc) AS last_event_ts,
  SUM(CASE WHEN event_type = 'recommendation_clicked' THEN 1 ELSE 0 END) / GREATEST(COUNT(*), 1) AS ctr,
  SUM(CASE WHEN event_type = 'lesson_completed' THEN 1 ELSE 0 END) / GREATEST(COUNT(*), 1) AS completion_rate
FROM ev WHERE timestamp_utc <= TIMESTAMP '{AS_OF}' GROUP BY user_id""", TE)
def f01(spark, sf):
    return EV.user_snapshot(_ev(spark, sf), F.lit(AS_OF).cast("timestamp_ntz"))


REWARD_SQL = f"""CASE WHEN event_type = 'rating_submitted' THEN {sc('COALESCE(CAST(rating AS DOUBLE), 3.0) / 5.0', 0.0, 1.5)}
  WHEN event_type = 'recommendation_clicked' THEN 1.0 WHEN event_type = 'lesson_completed' THEN 1.25
  WHEN event_type = 'lesson_started' THEN 0.35 WHEN event_type = 'recommendation_shown' THEN 0.05 ELSE 0.0 END"""


@register("f02_item_reward_stats", f"""WITH {EVS},
r AS (SELECT item_id, {REWARD_SQL} AS reward FROM ev WHERE item_id IS NOT NULL)
SELECT item_id, {sq('AVG(reward)')} AS reward_mean, CAST(COUNT(*) AS BIGINT) AS n,
       {sq('COUNT(*) / GREATEST(CAST((SELECT COUNT(*) FROM r) AS DOUBLE), 1.0)')} AS popularity
FROM r GROUP BY item_id""", TE)
def f02(spark, sf):
    ev = _ev(spark, sf).filter(F.col("item_id").isNotNull()).withColumn(
        "reward", S.event_reward("event_type", "rating"))
    r = EV.item_reward_stats(ev, "item_id")
    return r.select("item_id", scaled("reward_mean").alias("reward_mean"), F.col("n").cast("bigint").alias("n"),
                    scaled("popularity").alias("popularity"))


WEIGHT_SQL = """CASE event_type WHEN 'recommendation_clicked' THEN 2.0 WHEN 'lesson_completed' THEN 2.5 WHEN 'rating_submitted' THEN 1.5
  WHEN 'lesson_started' THEN 0.8 WHEN 'recommendation_shown' THEN 0.5 ELSE 1.0 END"""


@register("f03_item_popularity", f"""WITH {EVS}
SELECT item_id, CAST(SUM(CAST({WEIGHT_SQL} AS DECIMAL(18,6))) AS DOUBLE) AS popularity
FROM ev WHERE item_id IS NOT NULL GROUP BY item_id""", TE)
def f03(spark, sf):
    ev = _ev(spark, sf).filter(F.col("item_id").isNotNull()).withColumn(
        "interaction_weight", S.interaction_weight("event_type"))
    return EV.item_popularity(ev)


@register("f04_ordered_history", f"""WITH {EVS},
f AS (SELECT user_id, item_id, MIN((timestamp_utc, event_id)) AS fst FROM ev WHERE item_id IS NOT NULL GROUP BY user_id, item_id)
SELECT user_id, item_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY fst) AS INT) AS pos FROM f""", TE)
def f04(spark, sf):
    return EV.ordered_distinct_history(_ev(spark, sf), "user_id", "item_id", "timestamp_utc", "event_id")


SEQ_SQL = f"""{EVS},
s0 AS (SELECT user_id, session_id, item_id, timestamp_utc, event_id,
              COUNT(*) OVER (PARTITION BY user_id, session_id) AS n,
              ROW_NUMBER() OVER (PARTITION BY user_id, session_id ORDER BY timestamp_utc NULLS LAST, event_id) AS pos
       FROM ev WHERE item_id IS NOT NULL),
seq AS (SELECT * FROM s0 WHERE n >= 2)"""


@register("f05_vocabulary", f"""WITH {SEQ_SQL}
SELECT item_id AS item, CAST(COUNT(*) AS BIGINT) AS frequency,
       CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, item_id) + 1 AS INT) AS item_index
FROM seq GROUP BY item_id""", TE)
def f05(spark, sf):
    seq = EV.event_sequences(_ev(spark, sf)).withColumnRenamed("item_id", "item")
    return EV.item_vocabulary(seq).withColumn("frequency", F.col("frequency").cast("bigint"))


@register("f06_bigram_counts", f"""WITH {SEQ_SQL}
SELECT a.item_id AS left_item, b.item_id AS right_item, CAST(COUNT(*) AS BIGINT) AS n
FROM seq a JOIN seq b ON a.user_id = b.user_id AND a.session_id = b.session_id AND b.pos = a.pos + 1
GROUP BY 1, 2""", TE)
def f06(spark, sf):
    return EV.bigram_counts(EV.adjacent_pairs(EV.event_sequences(_ev(spark, sf))))


# ------------------------------------------------------------------ F8-F11
_SUM_COLS = K.NUMERIC_FEATURES


@register("f08_feature_summary", f"""WITH {FEAT_CTE.strip()},
l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM feat" for c in _SUM_COLS)})
SELECT feature, {sq('AVG(value)')} AS mean, {sq('STDDEV_POP(value)')} AS std, MIN(value) AS min, MAX(value) AS max,
       {sq('AVG(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END)')} AS null_rate
FROM l GROUP BY feature""", ("learners",))
def f08(spark, sf):
    s = MO.feature_summary(C.features(spark, sf), _SUM_COLS)
    return s.select("feature", scaled("mean").alias("mean"), scaled("std").alias("std"), "min", "max",
                    scaled("null_rate").alias("null_rate"))


def _psi_sql(ref: str, cur: str) -> str:
    return f"""rng AS (SELECT feature, CASE WHEN MIN(value) = MAX(value) THEN MIN(value) - 0.5 ELSE MIN(value) END AS lo,
                     CASE WHEN MIN(value) = MAX(value) THEN MAX(value) + 0.5 ELSE MAX(value) END AS hi
              FROM {ref} WHERE value IS NOT NULL GROUP BY feature),
ed AS (SELECT feature, lo, hi, i, CASE WHEN i = 10 THEN hi ELSE lo + i * ((hi - lo) / 10) END AS e FROM rng, range(11) r(i)),
bins AS (SELECT feature, i AS bin FROM ed WHERE i < 10),
asg AS (SELECT src, x.feature, x.value,
           (SELECT COUNT(*) FROM ed WHERE ed.feature = x.feature AND ed.i BETWEEN 1 AND 9 AND x.value >= ed.e) AS bin
        FROM (SELECT 't' AS src, feature, value FROM {ref} UNION ALL SELECT 'c', feature, value FROM {cur}) x
        JOIN rng ON rng.feature = x.feature WHERE x.value >= rng.lo AND x.value <= rng.hi),
cnt AS (SELECT b.feature, b.bin, COUNT(*) FILTER (WHERE src = 't') AS tn, COUNT(*) FILTER (WHERE src = 'c') AS cn
        FROM bins b LEFT JOIN asg a ON a.feature = b.feature AND a.bin = b.bin GROUP BY b.feature, b.bin),
rat AS (SELECT feature, GREATEST(tn / GREATEST(SUM(tn) OVER (PARTITION BY feature), 1), 1e-6) AS tr,
                        GREATEST(cn / GREATEST(SUM(cn) OVER (PARTITION BY feature), 1), 1e-6) AS cr FROM cnt)
SELECT feature, {sq('SUM((cr - tr) * ln(cr / tr))', 4)} AS psi FROM rat GROUP BY feature"""


# the train split and the rest, one row per feature and value
SPLIT_SQL = f"""{FEAT_CTE.strip()},
s AS (SELECT *, ('0x' || substr(md5('42:' || CAST(student_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 80 AS is_train FROM feat),
tref AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM s WHERE is_train" for c in _SUM_COLS)}),
tcur AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM s WHERE NOT is_train" for c in _SUM_COLS)})"""


@register("f09_psi", f"""WITH {SPLIT_SQL},
{_psi_sql('tref', 'tcur')}""", ("learners",))
def f09(spark, sf):
    f = EV.hash_split(C.features(spark, sf), "student_id")
    ref = MO.unpivot(f.filter("is_train"), _SUM_COLS)
    cur = MO.unpivot(f.filter("NOT is_train"), _SUM_COLS)
    return MO.psi(ref, cur).select("feature", scaled("psi", 4).alias("psi"))


def _requests(spark, sf):
    # request log binding: each recommendation_shown event is a served request;
    # its value is the latency in ms, a cache hit when the value is below 5
    ev = C.events(spark, sf)
    return ev.select(F.col("value").alias("latency_ms"), (F.col("value") < 5).alias("cache_hit"),
                     "event_type", "user_id")


def _floor_pct_sql(src: str, q: float, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    grp = f"{by}, " if by else ""
    return f"""(SELECT {grp}MIN(v) AS p FROM (
      SELECT {grp}v, SUM(c) OVER ({part} ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, SUM(c) OVER ({part}) AS n
      FROM (SELECT {grp}latency_ms AS v, COUNT(*) AS c FROM {src} WHERE latency_ms IS NOT NULL GROUP BY {grp}latency_ms) h) z
    WHERE cum > FLOOR({q} * (n - 1)) {('GROUP BY ' + by) if by else ''})"""


@register("f10_online_metrics", f"""WITH rq AS (SELECT value AS latency_ms, value < 5 AS cache_hit, event_type FROM feedback_events)
SELECT {_floor_pct_sql('rq', 0.5)} AS latency_p50_ms, {_floor_pct_sql('rq', 0.95)} AS latency_p95_ms,
       {_floor_pct_sql('rq', 0.99)} AS latency_p99_ms,
       (SELECT SUM(CAST(cache_hit AS INT)) / GREATEST(COUNT(*), 1) FROM rq) AS cache_hit_rate,
       (SELECT COUNT(*) FILTER (WHERE event_type = 'recommendation_clicked') / GREATEST(COUNT(*) FILTER (WHERE event_type = 'recommendation_shown'), 1) FROM rq) AS ctr,
       (SELECT COUNT(*) FILTER (WHERE event_type = 'lesson_completed') / GREATEST(COUNT(*) FILTER (WHERE event_type = 'recommendation_shown'), 1) FROM rq) AS completion_at_k_proxy
""", ("feedback_events",))
def f10(spark, sf):
    rq = _requests(spark, sf)
    return MO.online_metrics(rq, rq)


@register("f11_guardrails", f"""WITH ob AS (
  SELECT CASE WHEN ('0x' || substr(md5('reco_v3:' || CAST(user_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 50 THEN 'treatment' ELSE 'control' END AS bucket,
         value AS latency_ms, event_type <> 'error' AS success, value < 1.0 AS low_engagement_drop FROM feedback_events),
p AS {_floor_pct_sql('ob', 0.95, 'bucket')}
SELECT o.bucket, COUNT(*) FILTER (WHERE NOT success) / GREATEST(COUNT(*), 1) AS failure_rate,
       COALESCE(MIN(p.p), 0.0) AS latency_p95_ms,
       COUNT(*) FILTER (WHERE low_engagement_drop) / GREATEST(COUNT(*), 1) AS low_engagement_drop_rate
FROM ob o LEFT JOIN p ON p.bucket = o.bucket GROUP BY o.bucket""", ("feedback_events",))
def f11(spark, sf):
    ev = C.events(spark, sf)
    ob = ev.select(S.ab_bucket("user_id", "reco_v3", 50).alias("bucket"), F.col("value").alias("latency_ms"),
                   (F.col("event_type") != "error").alias("success"), (F.col("value") < 1.0).alias("low_engagement_drop"))
    return MO.guardrails(ob, "bucket")


# ------------------------------------------------------------------ W1-W11
@register("w01_event_sequences", f"""WITH {SEQ_SQL}
SELECT user_id, session_id, item_id, timestamp_utc, event_id, CAST(pos AS INT) AS pos FROM seq""", TE)
def w01(spark, sf):
    return EV.event_sequences(_ev(spark, sf))


@register("w02_adjacent_pairs", f"""WITH {SEQ_SQL}
SELECT a.user_id, a.session_id, CAST(a.pos AS INT) AS pos, a.item_id AS left_item, b.item_id AS right_item
FROM seq a JOIN seq b ON a.user_id = b.user_id AND a.session_id = b.session_id AND b.pos = a.pos + 1""", TE)
def w02(spark, sf):
    return EV.adjacent_pairs(EV.event_sequences(_ev(spark, sf)))


@register("w03_prefix_pairs", f"""WITH {SEQ_SQL}
SELECT t.user_id, t.session_id, CAST(t.pos AS INT) AS pos, t.item_id AS target,
  (SELECT string_agg(p.item_id, '|' ORDER BY p.pos) FROM seq p WHERE p.user_id = t.user_id AND p.session_id = t.session_id
     AND p.pos BETWEEN t.pos - 16 AND t.pos - 1) AS prefix
FROM seq t WHERE t.pos >= 2""", TE)
def w03(spark, sf):
    p = EV.prefix_pairs(EV.event_sequences(_ev(spark, sf)), 16)
    return p.select("user_id", "session_id", "pos", "target", F.array_join("prefix", "|").alias("prefix"))


@register("w04_last_n_items", f"""WITH {EVS},
r AS (SELECT user_id, item_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY timestamp_utc DESC NULLS FIRST, event_id DESC) AS rd
      FROM ev WHERE item_id IS NOT NULL)
SELECT user_id, item_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY rd DESC) AS INT) AS pos FROM r WHERE rd <= 20""", TE)
def w04(spark, sf):
    return EV.last_n_items(_ev(spark, sf), 20).select("user_id", "item_id", "pos")


@register("w05_collapse_repeats", f"""WITH {EVS},
o AS (SELECT *, LAG(item_id) OVER (PARTITION BY user_id ORDER BY timestamp_utc NULLS LAST, event_id) AS prev
      FROM ev WHERE item_id IS NOT NULL),
k AS (SELECT * FROM o WHERE prev IS NULL OR prev <> item_id),
r AS (SELECT user_id, item_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY timestamp_utc DESC NULLS FIRST, event_id DESC) AS rd FROM k)
SELECT user_id, item_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY rd DESC) AS INT) AS pos FROM r WHERE rd <= 50""", TE)
def w05(spark, sf):
    return EV.collapse_repeats(_ev(spark, sf), 50).select("user_id", "item_id", "pos")


@register("w06_positional_rank", f"""WITH {EVS}
SELECT event_id, CAST(ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY timestamp_utc, event_id) AS INT) AS position,
       1.0 / ROW_NUMBER() OVER (PARTITION BY session_id ORDER BY timestamp_utc, event_id) AS inverse_rank
FROM ev""", TE)
def w06(spark, sf):
    from pyspark.sql import Window
    w = Window.partitionBy("session_id").orderBy("timestamp_utc", "event_id")
    e = _ev(spark, sf).withColumn("position", F.row_number().over(w).cast("int"))
    return e.select("event_id", "position", (F.lit(1.0) / F.col("position")).alias("inverse_rank"))


@register("w07_w08_folds_split", """SELECT student_id,
  CAST(('0x' || substr(md5('42:' || CAST(student_id AS VARCHAR)), 1, 8))::BIGINT % 5 AS INT) AS fold,
  ('0x' || substr(md5('42:' || CAST(student_id AS VARCHAR)), 1, 8))::BIGINT % 100 < 80 AS is_train
FROM learners""", ("learners",))
def w07(spark, sf):
    df = EV.fold_assignment(C.learners(spark, sf).select("student_id"), "student_id", 5)
    return EV.hash_split(df, "student_id")


@register("w09_running_user_counters", f"""WITH {EVS}
SELECT event_id, user_id,
  CAST(COUNT(*) OVER w AS BIGINT) AS interactions,
  CAST(SUM(CASE WHEN event_type = 'recommendation_clicked' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS clicks,
  CAST(SUM(CASE WHEN event_type = 'lesson_completed' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS completions,
  LAST_VALUE(CASE WHEN event_type = 'rating_submitted' THEN rating END IGNORE NULLS) OVER w AS latest_rating,
  SUM(CASE WHEN event_type = 'recommendation_clicked' THEN 1 ELSE 0 END) OVER w / GREATEST(COUNT(*) OVER w, 1) AS ctr
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY timestamp_utc NULLS LAST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", TE)
def w09(spark, sf):
    r = EV.running_user_counters(_ev(spark, sf))
    return r.select("event_id", "user_id", F.col("interactions").cast("bigint").alias("interactions"),
                    F.col("clicks").cast("bigint").alias("clicks"), F.col("completions").cast("bigint").alias("completions"),
                    "latest_rating", "ctr")


@register("w10_running_item_counters", f"""WITH {EVS}
SELECT event_id, item_id,
  CAST(SUM(CASE WHEN event_type = 'recommendation_shown' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS views,
  CAST(SUM(CASE WHEN event_type = 'recommendation_clicked' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS item_clicks,
  SUM(CASE WHEN event_type = 'recommendation_clicked' THEN 1 ELSE 0 END) OVER w
    / GREATEST(SUM(CASE WHEN event_type = 'recommendation_shown' THEN 1 ELSE 0 END) OVER w, 1) AS item_ctr
FROM ev WHERE item_id IS NOT NULL
WINDOW w AS (PARTITION BY item_id ORDER BY timestamp_utc NULLS LAST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", TE)
def w10(spark, sf):
    r = EV.running_item_counters(_ev(spark, sf))
    return r.select("event_id", "item_id", F.col("views").cast("bigint").alias("views"),
                    F.col("item_clicks").cast("bigint").alias("item_clicks"), "item_ctr")


@register("w11_last_event", f"""WITH {EVS}
SELECT user_id, arg_max(event_type, (timestamp_utc, event_id)) AS last_event_type,
       arg_max({REWARD_SQL}, (timestamp_utc, event_id)) AS last_reward
FROM ev WHERE timestamp_utc IS NOT NULL GROUP BY user_id""", TE)
def w11(spark, sf):
    ev = _ev(spark, sf).withColumn("reward", S.event_reward("event_type", "rating"))
    return EV.last_event(ev)


# ------------------------------------------------------------------ S1-S6
@register("s01_s02_top_k_per_key", """SELECT subject_weakness, student_id, quiz_score,
  CAST(ROW_NUMBER() OVER (PARTITION BY subject_weakness ORDER BY quiz_score DESC, student_id) AS INT) AS rnk
FROM learners QUALIFY rnk <= 3""", ("learners",))
def s01(spark, sf):
    from pathwise.operators.ranking import top_k
    l = C.learners(spark, sf).select("subject_weakness", "student_id", "quiz_score")
    return top_k(l, "subject_weakness", [F.col("quiz_score").desc(), F.col("student_id")], 3, "rnk")


@register("s03_union_missing_columns", f"""WITH {EVS}
SELECT user_id, item_id, event_type AS source, CAST(NULL AS DOUBLE) AS interaction_weight FROM ev WHERE event_type = 'lesson_completed'
UNION ALL
SELECT user_id, item_id, NULL AS source, {WEIGHT_SQL} AS interaction_weight FROM ev WHERE event_type = 'recommendation_clicked'""", TE)
def s03(spark, sf):
    ev = _ev(spark, sf)
    a = ev.filter(F.col("event_type") == "lesson_completed").select("user_id", "item_id", F.col("event_type").alias("source"))
    b = ev.filter(F.col("event_type") == "recommendation_clicked").select(
        "user_id", "item_id", S.interaction_weight("event_type").alias("interaction_weight"))
    return EV.union_missing(a, b)


@register("s04_s05_s06_set_ops", f"""WITH {EVS},
a AS (SELECT DISTINCT user_id, item_id FROM ev WHERE event_type = 'recommendation_shown' AND item_id IS NOT NULL),
b AS (SELECT DISTINCT user_id, item_id FROM ev WHERE event_type = 'recommendation_clicked' AND item_id IS NOT NULL)
SELECT 'union' AS op, * FROM (SELECT * FROM a UNION SELECT * FROM b) u
UNION ALL SELECT 'intersect', * FROM (SELECT * FROM a INTERSECT SELECT * FROM b) i
UNION ALL SELECT 'difference', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b) d""", TE)
def s04(spark, sf):
    ev = _ev(spark, sf).filter(F.col("item_id").isNotNull())
    a = ev.filter(F.col("event_type") == "recommendation_shown").select("user_id", "item_id")
    b = ev.filter(F.col("event_type") == "recommendation_clicked").select("user_id", "item_id")
    u = EV.set_union(a, b).select(F.lit("union").alias("op"), "*")
    i = EV.set_intersect(a, b).select(F.lit("intersect").alias("op"), "*")
    d = EV.set_difference(a.distinct(), b, ["user_id", "item_id"]).select(F.lit("difference").alias("op"), "*")
    return u.unionByName(i).unionByName(d)

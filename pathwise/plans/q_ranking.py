"""Registered queries: ranking and re-ranking (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pathwise.functions.expressions import scaled
from pathwise.operators import candidates as D
from pathwise.operators import events as EV
from pathwise.operators import ranking as R
from pathwise.operators import scoring as S
from pathwise.plans import common as C
from pathwise.plans.catalog import register
from pathwise.plans.q_candidates import PRIOR_SQL, SEGMENTS, _item_features, _seg_ctes
from pathwise.plans.q_scoring import FINAL
from pathwise.plans.sqlparts import FEAT_CTE, RISK, clip as sc, scaled as sq

LT = ("learners", "topics")
LTE = ("learners", "topics", "feedback_events")


def _content(spark, sf, n=10):
    return D.content_candidates(C.learners(spark, sf), C.topics(spark, sf), n)


def _segment(spark, sf, n=5):
    return D.segment_popular(C.learners(spark, sf), C.topics(spark, sf), SEGMENTS, n)


# ---------------------------------------------------------------- E1/E2
@register("e01_e02_rank_candidates", f"""WITH {C.RATED_EVENTS_SQL},
it AS (SELECT item_id, CAST(SUM(CASE WHEN event_type = 'recommendation_clicked' THEN 1 ELSE 0 END) AS DOUBLE)
                 / GREATEST(SUM(CASE WHEN event_type = 'recommendation_shown' THEN 1 ELSE 0 END), 1) AS item_ctr,
              MAX(timestamp_utc) AS last_ts FROM ev WHERE item_id IS NOT NULL GROUP BY item_id),
at_time AS (SELECT MAX(timestamp_utc) AS t FROM ev),
snap AS (SELECT user_id, CAST(SUM(CASE WHEN event_type = 'recommendation_clicked' THEN 1 ELSE 0 END) AS DOUBLE) / GREATEST(COUNT(*), 1) AS ctr,
                CAST(SUM(CASE WHEN event_type = 'lesson_completed' THEN 1 ELSE 0 END) AS DOUBLE) / GREATEST(COUNT(*), 1) AS completion_rate
         FROM ev WHERE timestamp_utc IS NOT NULL GROUP BY user_id),
{PRIOR_SQL[:-1]}),
c AS (SELECT student_id, topic, CAST(pos AS INT) AS rnk FROM prior WHERE pos <= 10),
j AS (SELECT c.*, COALESCE((epoch_us(at_time.t) - epoch_us(it.last_ts)) / 3.6e9, 72.0) AS rec,
             COALESCE(it.item_ctr, 0.3) AS pop, COALESCE(s.ctr, 0.1) AS ctr, COALESCE(s.completion_rate, 0.3) AS comp
      FROM c LEFT JOIN it ON c.topic = it.item_id CROSS JOIN at_time LEFT JOIN snap s ON s.user_id = c.student_id),
f AS (SELECT student_id, topic, rnk,
        0.28 * 0.5 + 0.18 * (1.0 / (1.0 + ln(1 + rec))) + 0.14 * pop + 0.14 * comp + 0.08 * ctr
        + 0.08 * (1.0 / (1.0 + rec / 24.0)) + 0.06 * 0.5
        + 0.04 * (1.0 / GREATEST(len(list_distinct(string_split(topic, ' '))), 1)) + 0.02 * (1.0 / GREATEST(rnk, 1)) AS s
      FROM j)
SELECT student_id, topic, {sq('s')} AS rank_score,
       CAST(ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY s DESC, rnk, topic) AS INT) AS final_rnk
FROM f QUALIFY final_rnk <= 5""", LTE)
def e01(spark, sf):
    ev = C.rated_events(spark, sf)
    asof = ev.agg(F.max("timestamp_utc").alias("__asof"))
    cands = _content(spark, sf).crossJoin(F.broadcast(asof))
    c = D.item_feature_lookup(cands, _item_features(ev), "topic", F.col("__asof"))
    c = D.user_feature_lookup(c, EV.user_snapshot(ev), "student_id")
    r = R.rank_candidates(c, "student_id", 5)
    return r.select("student_id", "topic", scaled("rank_score").alias("rank_score"), "final_rnk")


# ------------------------------------------------------------------- E3
RERANK_TAIL = """rk AS (SELECT student_id, topic, ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY hybrid_score DESC, merged_rnk) AS pos FROM hs),
p AS (SELECT *, split_part(topic, ' ', 1) AS pref FROM rk),
f AS (SELECT *, CASE WHEN pos <= 2 OR pos = MIN(pos) OVER (PARTITION BY student_id, pref) THEN 0 ELSE 1 END AS pass FROM p),
sel AS (SELECT student_id, topic, ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY pass, pos) AS o FROM f QUALIFY o <= 5),
anc AS (SELECT student_id, topic FROM cl WHERE c_rank = 1),
ins AS (SELECT a.student_id, a.topic, 0 AS o FROM anc a
        WHERE NOT EXISTS (SELECT 1 FROM sel s WHERE s.student_id = a.student_id AND s.topic = a.topic))
SELECT student_id, topic, CAST(ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY o) AS INT) AS rerank_rnk
FROM (SELECT * FROM sel UNION ALL SELECT * FROM ins) u QUALIFY rerank_rnk <= 5"""

HYBRID_TAIL = """nc AS (SELECT student_id, COUNT(*) AS n FROM cl GROUP BY student_id),
nu AS (SELECT student_id, COUNT(*) AS n FROM ul GROUP BY student_id),
m AS (SELECT COALESCE(cl.student_id, ul.student_id) AS student_id, COALESCE(cl.topic, ul.topic) AS topic,
             cl.c_rank AS c0, ul.u_rank AS u0 FROM cl FULL OUTER JOIN ul ON cl.student_id = ul.student_id AND cl.topic = ul.topic),
h AS (SELECT m.student_id, m.topic,
             CAST(ROW_NUMBER() OVER (PARTITION BY m.student_id ORDER BY CASE WHEN c0 IS NULL THEN 1000000 + u0 ELSE c0 END) AS INT) AS merged_rnk,
             CAST(COALESCE(c0, COALESCE(nc.n, 0) + 5) AS INT) AS c_rank, CAST(COALESCE(u0, COALESCE(nu.n, 0) + 5) AS INT) AS u_rank,
             l.quiz_score
      FROM m LEFT JOIN nc ON nc.student_id = m.student_id LEFT JOIN nu ON nu.student_id = m.student_id
      JOIN learners l ON l.student_id = m.student_id),
hs AS (SELECT *, 0.52 * (1.0 / log2(GREATEST(c_rank, 1) + 1.0)) + 0.38 * (1.0 / log2(GREATEST(u_rank, 1) + 1.0))
                 + 0.10 * LEAST(GREATEST(quiz_score / 100.0, 0.0), 1.0)
                 + CASE WHEN (topic LIKE '%Basics%' OR topic LIKE '%Intro%') AND LEAST(GREATEST(quiz_score / 100.0, 0.0), 1.0) < 0.7 THEN 0.08
                        WHEN (topic LIKE '%Advanced%' OR topic LIKE '%Applications%' OR topic LIKE '%Analysis%' OR topic LIKE '%Multivariable%' OR topic LIKE '%Regression%')
                             AND LEAST(GREATEST(quiz_score / 100.0, 0.0), 1.0) >= 0.7 THEN 0.08 ELSE 0.0 END AS hybrid_score
       FROM h)"""

HYBRID_SQL = f"""{PRIOR_SQL[:-1]}),
{_seg_ctes()},
cl AS (SELECT student_id, topic, CAST(pos AS INT) AS c_rank FROM prior WHERE pos <= 10),
ul AS (SELECT student_id, topic, CAST(pos AS INT) AS u_rank FROM lb JOIN pool USING (band) WHERE pos <= 5),
{HYBRID_TAIL}"""


def _hybrid(spark, sf):
    return R.hybrid_scores(_content(spark, sf), _segment(spark, sf), C.learners(spark, sf), "student_id")


@register("e03_hybrid_scores", f"WITH {HYBRID_SQL}\nSELECT student_id, topic, merged_rnk, c_rank, u_rank, {sq('hybrid_score')} AS hybrid_score FROM hs", LT)
def e03(spark, sf):
    h = _hybrid(spark, sf)
    return h.select("student_id", "topic", "merged_rnk", "c_rank", "u_rank", scaled("hybrid_score").alias("hybrid_score"))


# ------------------------------------------------------------------- E4
@register("e04_diversity_rerank", f"""WITH {HYBRID_SQL},
{RERANK_TAIL}""", LT)
def e04(spark, sf):
    h = _hybrid(spark, sf)
    ranked = R.numbered(h, "student_id", [F.col("hybrid_score").desc(), F.col("merged_rnk")], "pos")
    anchors = _content(spark, sf).filter(F.col("rnk") == 1).select("student_id", "topic")
    return R.diversity_rerank(ranked.select("student_id", "topic", "pos"), "student_id", 5, "pos", anchors)


# ---------------------------------------------------------------- E5/F7
def _bandit_updates(spark, sf):
    ev = C.rated_events(spark, sf).filter(F.col("item_id").isNotNull())
    pop = EV.item_reward_stats(ev.withColumn("reward", S.event_reward("event_type", "rating")), "item_id")
    f = C.features(spark, sf).select(F.col("student_id").alias("user_id"), "quiz_score", "engagement_score",
                                     "consistency_score")
    u = (ev.join(f, "user_id", "left").join(F.broadcast(pop.select("item_id", "popularity")), "item_id", "left")
         .withColumn("freshness", F.lit(0.5)).withColumn("difficulty_match", F.lit(0.5)))
    u = u.withColumn("popularity", F.coalesce(F.col("popularity"), F.lit(0.0)))
    return u.select(F.col("item_id").alias("arm"), R.bandit_context(u).alias("x"),
                    S.event_reward("event_type", "rating").alias("reward"))


@register("f07_bandit_state", f"""WITH {FEAT_CTE.strip()}, {C.RATED_EVENTS_SQL},
pop AS (SELECT item_id, CAST(COUNT(*) AS DOUBLE) / GREATEST((SELECT COUNT(*) FROM ev WHERE item_id IS NOT NULL), 1.0) AS popularity
        FROM ev WHERE item_id IS NOT NULL GROUP BY item_id),
u AS (SELECT ev.item_id AS arm,
        [1.0, COALESCE(f.quiz_score, 50.0) / 100.0, COALESCE(f.engagement_score, 50.0) / 100.0,
         COALESCE(f.consistency_score, 50.0) / 100.0, 0.5, 0.5, COALESCE(pop.popularity, 0.0), 0.0, 0.0] AS x,
        CASE WHEN event_type = 'rating_submitted' THEN {sc('COALESCE(CAST(rating AS DOUBLE), 3.0) / 5.0', 0.0, 1.5)}
             WHEN event_type = 'recommendation_clicked' THEN 1.0 WHEN event_type = 'lesson_completed' THEN 1.25
             WHEN event_type = 'lesson_started' THEN 0.35 WHEN event_type = 'recommendation_shown' THEN 0.05 ELSE 0.0 END AS r
      FROM ev LEFT JOIN feat f ON f.student_id = ev.user_id LEFT JOIN pop ON pop.item_id = ev.item_id
      WHERE ev.item_id IS NOT NULL),
cells AS (SELECT arm, i, j, x[i + 1] * x[j + 1] AS v FROM u, range(9) a(i), range(9) b(j))
SELECT arm, CAST(i * 9 + j AS INT) AS cell,
       {sq('CAST(SUM(CAST(v AS DECIMAL(30,12))) AS DOUBLE) + CASE WHEN i = j THEN 1.0 ELSE 0.0 END')} AS value
FROM cells GROUP BY arm, i, j
UNION ALL
SELECT arm, CAST(81 + i AS INT), {sq('CAST(SUM(CAST(' + sc('r', 0.0, 1.5) + ' * x[i + 1] AS DECIMAL(30,12))) AS DOUBLE)')}
FROM u, range(9) a(i) GROUP BY arm, i
UNION ALL
SELECT arm, 90, CAST(COUNT(*) AS BIGINT) FROM u GROUP BY arm""", LTE)
def f07(spark, sf):
    st = R.bandit_state(_bandit_updates(spark, sf))
    a = st.select("arm", F.posexplode("A").alias("cell", "value")).select(
        "arm", F.col("cell").cast("int").alias("cell"), scaled("value").alias("value"))
    b = st.select("arm", F.posexplode("b").alias("cell", "value")).select(
        "arm", (F.col("cell") + 81).cast("int").alias("cell"), scaled("value").alias("value"))
    n = st.select("arm", F.lit(90).alias("cell"), F.col("n").cast("bigint").alias("value"))
    return a.unionByName(b).unionByName(n)


@register("e05_bandit_scores")
def e05(spark, sf):
    solved = R.bandit_solve(R.bandit_state(_bandit_updates(spark, sf)))
    cands = _content(spark, sf).join(C.features(spark, sf).select(
        "student_id", "engagement_score", "consistency_score"), "student_id")
    cands = cands.withColumn("x", R.bandit_context(cands))
    return R.bandit_scores(cands, solved).select("student_id", "topic", "rnk", "bandit_score")


# ------------------------------------------------------------------- E6
def _sequences(spark, sf):
    ev = C.rated_events(spark, sf)
    return ev, EV.event_sequences(ev)


@register("e06_transition_scores", f"""WITH {C.RATED_EVENTS_SQL},
s0 AS (SELECT *, COUNT(*) OVER (PARTITION BY user_id, session_id) AS n,
              ROW_NUMBER() OVER (PARTITION BY user_id, session_id ORDER BY timestamp_utc NULLS LAST, event_id) AS pos
       FROM ev WHERE item_id IS NOT NULL),
seq AS (SELECT * FROM s0 WHERE n >= 2),
bg AS (SELECT a.item_id AS l, b.item_id AS r, COUNT(*) AS c FROM seq a JOIN seq b
         ON a.user_id = b.user_id AND a.session_id = b.session_id AND b.pos = a.pos + 1 GROUP BY 1, 2),
fr AS (SELECT item_id, COUNT(*) AS c FROM seq GROUP BY item_id),
last AS (SELECT user_id, arg_max(item_id, (timestamp_utc, event_id)) AS li FROM ev
         WHERE item_id IS NOT NULL AND timestamp_utc IS NOT NULL GROUP BY user_id),
{PRIOR_SQL[:-1]}),
c AS (SELECT p.student_id, p.topic, CAST(p.pos AS INT) AS rnk FROM prior p WHERE pos <= 10),
raw AS (SELECT c.*, CAST(CASE WHEN last.li IS NULL OR NOT EXISTS (SELECT 1 FROM bg WHERE bg.l = last.li)
                    THEN COALESCE(fr.c, 0) ELSE COALESCE(bg.c, 0) END AS DOUBLE) AS v
        FROM c LEFT JOIN last ON last.user_id = c.student_id LEFT JOIN fr ON fr.item_id = c.topic
        LEFT JOIN bg ON bg.l = last.li AND bg.r = c.topic)
SELECT student_id, topic, rnk, {sq('GREATEST(v, 0.0) / GREATEST(SUM(GREATEST(v, 0.0)) OVER (PARTITION BY student_id), 1e-6)')} AS sequence_score
FROM raw""", LTE)
def e06(spark, sf):
    ev, seq = _sequences(spark, sf)
    pairs = EV.adjacent_pairs(seq)
    big = EV.bigram_counts(pairs)
    freq = seq.groupBy(F.col("item_id").alias("item")).agg(F.count(F.lit(1)).alias("frequency"))
    last = EV.last_event(ev.filter(F.col("item_id").isNotNull()), cols=("item_id",)).select(
        F.col("user_id").alias("student_id"), F.col("last_item_id").alias("last_item"))
    cands = _content(spark, sf).select("student_id", "topic", "rnk")
    r = R.transition_scores(cands, last, big, freq, "student_id")
    return r.select("student_id", "topic", "rnk", scaled("sequence_score").alias("sequence_score"))


# ------------------------------------------------------------------- E7
@register("e07_online_scores", f"""WITH {C.RATED_EVENTS_SQL},
hv AS (SELECT topic, i, CAST(('0x' || substr(sha256(topic), 2 * i + 1, 2))::INTEGER AS DOUBLE) / 255.0 AS h FROM topics, range(9) r(i)),
uv AS (SELECT ev.user_id, hv.i, AVG(hv.h) AS u FROM ev JOIN hv ON hv.topic = ev.item_id
       WHERE ev.event_type = 'recommendation_clicked' GROUP BY ev.user_id, hv.i),
{PRIOR_SQL[:-1]}),
c AS (SELECT student_id, topic, CAST(pos AS INT) AS rnk FROM prior WHERE pos <= 10),
iv AS (SELECT topic, i, 0.7 * h + 0.3 * CASE i WHEN 0 THEN 0.5 WHEN 1 THEN 0.5 WHEN 2 THEN 0.5 WHEN 3 THEN 0.5
                                         WHEN 4 THEN 0.72 WHEN 5 THEN 0.3 WHEN 6 THEN 1.0 ELSE 0.5 END AS v FROM hv)
SELECT c.student_id, c.topic, c.rnk,
  {sq('COALESCE((SELECT SUM(uv.u * iv.v) FROM uv JOIN iv ON iv.i = uv.i WHERE uv.user_id = c.student_id AND iv.topic = c.topic), 0.0)')} AS online_score
FROM c""", LTE)
def e07(spark, sf):
    ev = C.rated_events(spark, sf)
    t = C.topics(spark, sf).select("topic", S.hashed_vector("topic").alias("h"))
    clicks = ev.filter(F.col("event_type") == "recommendation_clicked").join(
        F.broadcast(t), ev.item_id == t.topic)
    long = clicks.select("user_id", F.posexplode("h").alias("i", "x"))
    uv = (long.groupBy("user_id", "i").agg(F.avg("x").alias("x"))
          .groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("__s"))
          .select(F.col("user_id").alias("student_id"), F.col("__s.x").alias("vector")))
    cands = _content(spark, sf).select("student_id", "topic", "rnk").join(F.broadcast(t), "topic")
    cands = cands.withColumn("item_vec", R.online_item_vector(F.col("h"), {}))
    r = R.online_scores(cands, uv, "student_id")
    return r.select("student_id", "topic", "rnk", scaled("online_score").alias("online_score"))


# ------------------------------------------------------------------ E10
_C9 = sc("0.45 * quiz_score + 0.35 * consistency_score + 0.2 * engagement_score", 0, 100)


@register("e10_risk_priority_order", f"""WITH {FEAT_CTE.strip()}, {PRIOR_SQL[:-1]}),
c AS (SELECT p.student_id, p.topic, CAST(p.pos AS INT) AS rnk, f.subject_weakness,
             {sc("0.45 * f.quiz_score + 0.35 * f.consistency_score + 0.2 * f.engagement_score", 0, 100)} AS base
      FROM prior p JOIN feat f ON f.student_id = p.student_id WHERE p.pos <= 5),
a AS (SELECT *, {sc('''base + CASE WHEN lower(COALESCE(subject_weakness, '')) <> '' AND strpos(lower(topic), lower(subject_weakness)) > 0 THEN -9.0 ELSE 0.0 END
      + CASE WHEN regexp_matches(lower(topic), 'advanced|calculus|challenge|optimization') THEN -4.0 ELSE 0.0 END
      + CASE WHEN regexp_matches(lower(topic), 'intro|fundamentals|basics|starter') THEN 3.0 ELSE 0.0 END''', 0, 100)} AS ps FROM c)
SELECT student_id, topic, {RISK.format(s='ps')} AS topic_risk_level,
  CAST(ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY CASE WHEN ps < 50 THEN 0 WHEN ps < 70 THEN 1 ELSE 2 END, ps, rnk) AS INT) AS priority_rnk
FROM a""", LT)
def e10(spark, sf):
    f = C.features(spark, sf).select("student_id", "subject_weakness", "quiz_score", "consistency_score", "engagement_score")
    c = D.content_candidates(f, C.topics(spark, sf), 5, keep=["student_id", "subject_weakness", "quiz_score",
                                                               "consistency_score", "engagement_score"])
    c = c.withColumn("base_score", S.base_score_proxy("quiz_score", "consistency_score", "engagement_score"))
    r = R.risk_priority_order(S.topic_insight(c), "student_id")
    return r.select("student_id", "topic", "topic_risk_level", "priority_rnk")


# ------------------------------------------------------------------ E11
EXTRA_SUBJECTS = {"medium": "PROMO", "low": "SMALL"}  # binding: stand-ins for the two extra subjects


@register("e11_risk_assembly", f"""WITH {FEAT_CTE.strip()}, {PRIOR_SQL[:-1]}),
fs AS (SELECT student_id, {FINAL} AS fscore FROM feat),
rl AS (SELECT student_id, {RISK.format(s='fscore')} AS risk_level FROM fs),
own AS (SELECT p.student_id, p.topic, p.pos AS o FROM prior p JOIN rl USING (student_id)
        WHERE p.pos <= CASE risk_level WHEN 'high' THEN 5 WHEN 'medium' THEN 4 ELSE 3 END),
ext AS (SELECT rl.student_id, t.topic, 100 + t.rnk AS o FROM rl JOIN topics t
        ON (rl.risk_level = 'medium' AND t.subject = '{EXTRA_SUBJECTS["medium"]}' AND t.rnk <= 1)
        OR (rl.risk_level = 'low' AND t.subject = '{EXTRA_SUBJECTS["low"]}' AND t.rnk <= 2)),
u AS (SELECT * FROM own UNION ALL SELECT * FROM ext),
d AS (SELECT * FROM u QUALIFY ROW_NUMBER() OVER (PARTITION BY student_id, topic ORDER BY o) = 1)
SELECT student_id, topic, CAST(ROW_NUMBER() OVER (PARTITION BY student_id ORDER BY o) AS INT) AS final_rnk
FROM d QUALIFY final_rnk <= 5""", LT)
def e11(spark, sf):
    f = C.features(spark, sf)
    t = C.topics(spark, sf)
    base = D.content_candidates(f, t, 5).select("student_id", "topic", "rnk")
    risk = f.select("student_id", S.risk_level("final_score").alias("risk_level"))
    extras = t.filter(F.col("subject") == EXTRA_SUBJECTS["medium"]).select(F.lit("medium").alias("band"), "topic", "rnk") \
        .unionByName(t.filter(F.col("subject") == EXTRA_SUBJECTS["low"]).select(F.lit("low").alias("band"), "topic", "rnk"))
    return R.risk_assembly(base, risk, extras, "student_id").select("student_id", "topic", "final_rnk")


@register("e13_sparse_blend")
def e13(spark, sf):
    seq = e06(spark, sf).withColumn("bigram", F.col("sequence_score").cast("double"))
    on = e07(spark, sf).select("student_id", "topic", F.col("online_score").cast("double").alias("model"))
    return R.sparse_blend(seq.join(on, ["student_id", "topic"]), "student_id", "model", "bigram").select(
        "student_id", "topic", "blend_score")


@register("e12_learned_ranker")
def e12(spark, sf):
    from pathwise.operators.evaluation import difficulty_relevance
    h = _hybrid(spark, sf).join(C.learners(spark, sf).select("student_id", "quiz_score"), "student_id")
    rel = difficulty_relevance(C.learners(spark, sf), C.topics(spark, sf)).withColumn("label", F.lit(1.0))
    d = EV.hash_split(h.join(rel, ["student_id", "topic"], "left").fillna(0.0, ["label"]), "student_id")
    model = R.learned_ranker(d.filter("is_train"), "label", ["c_rank", "u_rank", "quiz_score"])
    return R.rank_by_model(model, d.filter("NOT is_train"), "student_id", 5).select(
        "student_id", "topic", "model_score", "model_rnk")


@register("e09_adaptive_blend")
def e09(spark, sf):
    seq = e06(spark, sf).withColumn("sequence_score", F.col("sequence_score") / 1e6)
    on = e07(spark, sf).select("student_id", "topic", (F.col("online_score") / 1e6).alias("online_score"))
    ban = e05(spark, sf).select("student_id", "topic", "bandit_score")
    j = seq.join(on, ["student_id", "topic"]).join(ban, ["student_id", "topic"])
    return R.adaptive_blend(j, "student_id", 5).select("student_id", "topic", "adaptive_score", "adaptive_rnk")

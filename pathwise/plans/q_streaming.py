"""Registered queries: streaming feedback path.

The events arrive in three deliveries by event time.  Some events come a delivery late, some are delivered twice and, except
for the window queries, which drop what is older than their watermark, some come ten days and more late.  After each delivery the query's streams run
over what is new (``availableNow``) on the same checkpoint, so every result has gone through three
micro-batches and two restarts.  An ingest stream (G1) writes the de-duplicated log; the others read
that log.  Results are compared with the same SQL oracle as the batch path.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pathwise.operators import candidates as D
from pathwise.operators import ranking as R
from pathwise.operators import scoring as S
from pathwise.plans import common as C
from pathwise.plans.catalog import register
from pathwise.plans.q_candidates import PRIOR_SQL
from pathwise.plans.q_events import REWARD_SQL, SEQ_SQL
from pathwise.plans.sqlparts import FEAT_CTE, clip as sc, scaled as sq
from pathwise.sources import tables
from pathwise.streaming import feedback as G
from pathwise.streaming import state as ST

TE = ("topics", "feedback_events")
EVS = C.RATED_EVENTS_SQL


def arrivals(spark, sf, days_late: bool = True):
    """The event table as three deliveries (a third of the time span each).

    Some events of the first third's last six hours come with the second delivery, and some of the second
    third's last six hours come again with the third.  With ``days_late`` some events of the first third come with the
    third delivery only, some of those twice: ten days and more behind the watermark.
    """
    ev = tables.read_table(spark, sf, "events")
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    t1, t2 = F.lit(lo + (hi - lo) / 3).cast(ev.schema["ts"].dataType), F.lit(lo + (hi - lo) * 2 / 3).cast(ev.schema["ts"].dataType)
    hours = F.expr("INTERVAL 6 HOURS")
    ts = F.col("ts")
    part = F.when(ts.isNull() | (ts < t1), 1).when(ts < t2, 2).otherwise(3)
    held = F.coalesce((ts < t1) & (ts >= t1 - hours) & (F.col("event_id") % 17 == 0), F.lit(False))
    late = F.coalesce((ts < t1 - hours) & (F.col("event_id") % 13 == 0), F.lit(False)) if days_late else F.lit(False)
    again = (ts < t2) & (ts >= t2 - hours) & (F.col("event_id") % 5 == 0)
    third = ev.filter((part == 3) | again | late)
    return [ev.filter((part == 1) & ~held & ~late), ev.filter((part == 2) | held),
            third.unionByName(ev.filter(late & (F.col("event_id") % 2 == 0)))]


def shaped(spark, sf, raw):
    """Feedback events with topic item ids, rating fixture, reward, key and date, from raw event rows."""
    fe = tables.shape_feedback(raw, tables.n_topics(spark, sf))
    t = C.topics(spark, sf).select("topic_idx", F.col("topic").alias("item_id"))
    err = F.col("event_type") == "error"
    s = (fe.join(t, "topic_idx", "left")
         .withColumn("rating", F.when(err, F.col("event_id") % 5 + 1))
         .withColumn("idempotency_key", S.idempotency_key(
             F.lit(None).cast("string"), item=F.col("topic_idx").cast("string"), payload=F.lit("{}")))
         .withColumn("event_type", F.when(err, "rating_submitted").otherwise(F.col("event_type")))
         .withColumn("event_ts", F.col("timestamp_utc").cast("timestamp"))
         .withColumn("event_date", F.to_date("timestamp_utc")))
    return s.withColumn("reward", S.event_reward("event_type", "rating"))


def deliver(spark, parts, run_dir, step):
    """Append one delivery after the other to a folder and run ``step(stream of raw rows)`` after each."""
    src = f"{run_dir}/source"
    for part in parts:
        part.write.mode("append").parquet(src)
        out = step(spark.readStream.schema(part.schema).parquet(src))
    return out


DELAY = "1 day"


def ingest(spark, sf, run_dir, raw):
    """G1: the de-duplicated log of what has arrived so far."""
    return G.run_ingest(spark, shaped(spark, sf, raw), f"{run_dir}/ingest", "idempotency_key", delay=DELAY)


def log_stream(spark, run_dir):
    """The log as a stream of its own."""
    path = f"{run_dir}/ingest/log"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def on_log(spark, sf, name, build, keys, days_late=True, idle=True):
    """Run the update-mode stream ``build(log)`` behind the ingest, delivery by delivery; its current rows."""
    run_dir = G.new_run_dir(spark, name)

    def step(raw):
        ingest(spark, sf, run_dir, raw)
        return G.run_updates(spark, build(log_stream(spark, run_dir)), f"{run_dir}/state", keys, idle)

    return deliver(spark, arrivals(spark, sf, days_late), run_dir, step)


def _ntz(c):
    return F.col(c).cast("timestamp_ntz").alias(c)


@register("g01_idempotent_ingest", """SELECT DISTINCT sha256(to_json({'event_type': event_type, 'item_id': CAST(topic_idx AS VARCHAR),
      'payload': '{}', 'session_id': session_id, 'timestamp_utc': strftime(timestamp_utc, '%Y-%m-%dT%H:%M:%S.%f'),
      'user_id': CAST(user_id AS VARCHAR)})) AS idempotency_key, event_id FROM feedback_events""", ("feedback_events",))
def g01(spark, sf):
    # the log's key leaves the rating fixture out: the relabelled events get their own type back
    run_dir = G.new_run_dir(spark, "g01")

    def step(raw):
        fe = tables.shape_feedback(raw, tables.n_topics(spark, sf))
        # on top of the repeated delivery a retry burst: every click is delivered twice at once
        s = fe.unionByName(fe.filter(F.col("event_type") == "recommendation_clicked"))
        s = (s.withColumn("idempotency_key", S.idempotency_key(
                F.lit(None).cast("string"), item=F.col("topic_idx").cast("string"), payload=F.lit("{}")))
             .withColumn("event_ts", F.col("timestamp_utc").cast("timestamp"))
             .withColumn("event_date", F.to_date("timestamp_utc")))
        return G.run_ingest(spark, s, run_dir, "idempotency_key", delay=DELAY)

    return deliver(spark, arrivals(spark, sf), run_dir, step).select("idempotency_key", "event_id")


G2_SQL = f"""WITH {EVS}
SELECT user_id, CAST(COUNT(*) AS BIGINT) AS interactions,
  CAST(COUNT(*) FILTER (WHERE event_type = 'recommendation_clicked') AS BIGINT) AS clicks,
  CAST(COUNT(*) FILTER (WHERE event_type = 'lesson_completed') AS BIGINT) AS completions,
  arg_max(rating, (timestamp_utc, event_id)) FILTER (WHERE rating IS NOT NULL AND event_type = 'rating_submitted') AS latest_rating,
  arg_max(event_type, (timestamp_utc, event_id)) AS last_event_type, MAX(timestamp_utc) AS last_event_ts,
  COUNT(*) FILTER (WHERE event_type = 'recommendation_clicked') / GREATEST(COUNT(*), 1) AS ctr,
  COUNT(*) FILTER (WHERE event_type = 'lesson_completed') / GREATEST(COUNT(*), 1) AS completion_rate
FROM ev GROUP BY user_id"""


def _g2_out(t):
    return t.select("user_id", F.col("interactions").cast("bigint").alias("interactions"),
                    F.col("clicks").cast("bigint").alias("clicks"), F.col("completions").cast("bigint").alias("completions"),
                    "latest_rating", "last_event_type", _ntz("last_event_ts"), "ctr", "completion_rate")


@register("g02_online_user_features", G2_SQL, TE)
def g02(spark, sf):
    return _g2_out(on_log(spark, sf, "g02", G.online_user_features, ["user_id"]))


@register("g03_online_item_features", f"""WITH {EVS}
SELECT item_id, CAST(COUNT(*) FILTER (WHERE event_type = 'recommendation_shown') AS BIGINT) AS views,
  CAST(COUNT(*) FILTER (WHERE event_type = 'recommendation_clicked') AS BIGINT) AS clicks, MAX(timestamp_utc) AS last_event_ts,
  COUNT(*) FILTER (WHERE event_type = 'recommendation_clicked') / GREATEST(COUNT(*) FILTER (WHERE event_type = 'recommendation_shown'), 1) AS item_ctr
FROM ev WHERE item_id IS NOT NULL GROUP BY item_id""", TE)
def g03(spark, sf):
    t = on_log(spark, sf, "g03", G.online_item_features, ["item_id"])
    return t.select("item_id", F.col("views").cast("bigint").alias("views"), F.col("clicks").cast("bigint").alias("clicks"),
                    _ntz("last_event_ts"), "item_ctr")


@register("g04_recent_sequence_state", f"""WITH {EVS},
r AS (SELECT user_id, item_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY timestamp_utc DESC NULLS FIRST, event_id DESC) AS rd
      FROM ev WHERE item_id IS NOT NULL),
lr AS (SELECT user_id, arg_max({REWARD_SQL}, (timestamp_utc, event_id)) AS last_reward FROM ev WHERE timestamp_utc IS NOT NULL GROUP BY user_id)
SELECT r.user_id, CAST(ROW_NUMBER() OVER (PARTITION BY r.user_id ORDER BY rd DESC) AS INT) AS pos, r.item_id, lr.last_reward
FROM r LEFT JOIN lr USING (user_id) WHERE rd <= 24""", TE)
def g04(spark, sf):
    return on_log(spark, sf, "g04", ST.recent_items, ["user_id"], idle=False)


def vector_input(df):
    return df.withColumn("item_vec", F.when(F.col("item_id").isNotNull(), S.hashed_vector("item_id"))
                         .otherwise(F.array(F.lit(1.0), *[F.lit(0.0)] * 8)))


@register("g05_online_user_vectors")
def g05(spark, sf):
    # late events up to six hours find their place within the horizon of a day
    return on_log(spark, sf, "g05", lambda log: ST.user_vectors(vector_input(log)), ["user_id"], days_late=False, idle=False)


@register("g05b_user_vectors_batch")
def g05b(spark, sf):
    e = C.rated_events(spark, sf).withColumn("event_ts", F.col("timestamp_utc").cast("timestamp")) \
        .withColumn("reward", S.event_reward("event_type", "rating"))
    return G.online_user_vectors_batch(vector_input(e))


G6_SQL = f"""WITH {FEAT_CTE.strip()}, {EVS},
u AS (SELECT ev.item_id AS arm,
        [1.0, COALESCE(f.quiz_score, 50.0) / 100.0, COALESCE(f.engagement_score, 50.0) / 100.0,
         COALESCE(f.consistency_score, 50.0) / 100.0, 0.5, 0.5, 0.3, 0.0, 0.0] AS x,
        {REWARD_SQL} AS r
      FROM ev LEFT JOIN feat f ON f.student_id = ev.user_id WHERE ev.item_id IS NOT NULL),
cells AS (SELECT arm, i, j, x[i + 1] * x[j + 1] AS v FROM u, range(9) a(i), range(9) b(j))
SELECT arm, CAST(i * 9 + j AS INT) AS cell,
       {sq('CAST(SUM(CAST(v AS DECIMAL(30,12))) AS DOUBLE) + CASE WHEN i = j THEN 1.0 ELSE 0.0 END')} AS value
FROM cells GROUP BY arm, i, j
UNION ALL
SELECT arm, CAST(81 + i AS INT), {sq('CAST(SUM(CAST(' + sc('r', 0.0, 1.5) + ' * x[i + 1] AS DECIMAL(30,12))) AS DOUBLE)')}
FROM u, range(9) a(i) GROUP BY arm, i
UNION ALL
SELECT arm, 90, CAST(COUNT(*) AS BIGINT) FROM u GROUP BY arm"""


def bandit_stream(spark, sf, log):
    """The bandit state of every item's arm from the log's rewards and the users' features."""
    f = C.features(spark, sf).select(F.col("student_id").alias("user_id"), "quiz_score", "engagement_score",
                                     "consistency_score")
    s = log.filter(F.col("item_id").isNotNull()).join(f, "user_id", "left")
    s = s.select("item_id", "quiz_score", "engagement_score", "consistency_score", "reward")
    return R.bandit_state(s.select(F.col("item_id").alias("arm"), R.bandit_context(s).alias("x"), "reward"))


@register("g06_online_bandit_update", G6_SQL, ("learners", "topics", "feedback_events"))
def g06(spark, sf):
    from pathwise.functions.expressions import scaled
    st = on_log(spark, sf, "g06", lambda log: bandit_stream(spark, sf, log), ["arm"])
    a = st.select("arm", F.posexplode("A").alias("cell", "value")).select(
        "arm", F.col("cell").cast("int").alias("cell"), scaled("value").alias("value"))
    b = st.select("arm", F.posexplode("b").alias("cell", "value")).select(
        "arm", (F.col("cell") + 81).cast("int").alias("cell"), scaled("value").alias("value"))
    n = st.select("arm", F.lit(90).alias("cell"), F.col("n").cast("bigint").alias("value"))
    return a.unionByName(b).unionByName(n)


@register("g07_online_bigram_update", f"""WITH {SEQ_SQL}
SELECT a.item_id AS left_item, b.item_id AS right_item, CAST(COUNT(*) AS BIGINT) AS n
FROM seq a JOIN seq b ON a.user_id = b.user_id AND a.session_id = b.session_id AND b.pos = a.pos + 1
GROUP BY 1, 2""", TE)
def g07(spark, sf):
    run_dir = G.new_run_dir(spark, "g07")

    def step(raw):
        ingest(spark, sf, run_dir, raw)
        return G.run_append_log(spark, ST.session_pairs(log_stream(spark, run_dir)), f"{run_dir}/state", idle=False)

    changes = deliver(spark, arrivals(spark, sf), run_dir, step)
    return changes.groupBy("left_item", "right_item").agg(F.sum("n").cast("bigint").alias("n")).filter(F.col("n") > 0)


@register("g08_shown_event_emission", f"""WITH {PRIOR_SQL}
SELECT 'recommendation_shown' AS event_type, student_id AS user_id, topic AS item_id,
       CAST(student_id AS VARCHAR) || ':rec' AS session_id, CAST(pos AS INT) AS position
FROM prior WHERE pos <= 5""", ("learners", "topics"))
def g08(spark, sf):
    recs = D.content_candidates(C.learners(spark, sf), C.topics(spark, sf), 5)
    ev = G.shown_events(recs)
    path = G.new_run_dir(spark, "g08") + "/log"
    ev.write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _win_sql(bucket: str, extra: str = "") -> str:
    return f"""WITH {EVS}, b AS (SELECT *, {bucket} AS ws FROM ev {extra})
SELECT CAST(ws AS TIMESTAMP) AS window_start, CAST(ws + INTERVAL '1 day' * {2 if extra else 1} AS TIMESTAMP) AS window_end,
  CAST(COUNT(*) FILTER (WHERE event_type = 'recommendation_shown') AS BIGINT) AS shown,
  CAST(COUNT(*) FILTER (WHERE event_type = 'recommendation_clicked') AS BIGINT) AS clicks,
  CAST(COUNT(*) FILTER (WHERE event_type = 'lesson_completed') AS BIGINT) AS completed,
  COUNT(*) FILTER (WHERE event_type = 'recommendation_clicked') / GREATEST(COUNT(*) FILTER (WHERE event_type = 'recommendation_shown'), 1) AS ctr,
  COUNT(*) FILTER (WHERE event_type = 'lesson_completed') / GREATEST(COUNT(*) FILTER (WHERE event_type = 'recommendation_shown'), 1) AS completion_rate
FROM b GROUP BY ws"""


def _win_out(t):
    return t.select(_ntz("window_start"), _ntz("window_end"), F.col("shown").cast("bigint").alias("shown"),
                    F.col("clicks").cast("bigint").alias("clicks"), F.col("completed").cast("bigint").alias("completed"),
                    "ctr", "completion_rate")


@register("g09_rolling_rates_tumbling", _win_sql("date_trunc('day', timestamp_utc)"), TE)
def g09(spark, sf):
    return _win_out(on_log(spark, sf, "g09", G.rolling_rates, ["window_start"], days_late=False))


@register("g09b_rolling_rates_sliding", _win_sql(
    "d", ", LATERAL (SELECT UNNEST([date_trunc('day', timestamp_utc), date_trunc('day', timestamp_utc) - INTERVAL '1 day']) AS d) x"), TE)
def g09b(spark, sf):
    return _win_out(on_log(spark, sf, "g09b", lambda log: G.rolling_rates(log, duration="2 days", slide="1 day"),
                           ["window_start"], days_late=False))


@register("g10_sessions", f"""WITH {EVS},
g AS (SELECT user_id, timestamp_utc,
        CASE WHEN LAG(timestamp_utc) OVER (PARTITION BY user_id ORDER BY timestamp_utc) IS NULL
               OR timestamp_utc - LAG(timestamp_utc) OVER (PARTITION BY user_id ORDER BY timestamp_utc) >= INTERVAL '30 minutes'
             THEN 1 ELSE 0 END AS brk FROM ev),
s AS (SELECT *, SUM(brk) OVER (PARTITION BY user_id ORDER BY timestamp_utc ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, MIN(timestamp_utc) AS session_start, MAX(timestamp_utc) + INTERVAL '30 minutes' AS session_end,
       CAST(COUNT(*) AS BIGINT) AS events
FROM s GROUP BY user_id, sid""", TE)
def g10(spark, sf):
    run_dir = G.new_run_dir(spark, "g10")
    parts = arrivals(spark, sf, days_late=False)
    # a last event of nobody, far ahead, lets the watermark pass the open sessions
    end = parts[2].orderBy(F.desc("ts")).limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 30 DAYS")).withColumn(
        "user_id", F.lit(-1).cast(parts[2].schema["user_id"].dataType)).withColumn("event_id", F.lit(-1).cast(parts[2].schema["event_id"].dataType))

    def step(raw):
        ingest(spark, sf, run_dir, raw)
        return G.run_append_log(spark, G.sessions(log_stream(spark, run_dir), delay=DELAY), f"{run_dir}/state")

    s = deliver(spark, [*parts, end], run_dir, step).filter(F.col("user_id") != -1)
    return s.select("user_id", _ntz("session_start"), _ntz("session_end"), F.col("events").cast("bigint").alias("events"))


@register("g11_ttl_live_features", f"""WITH g2 AS ({G2_SQL.replace('WITH ' + EVS, '')}),
ev0 AS (SELECT MAX(timestamp_utc) AS t FROM feedback_events)
SELECT g2.* FROM g2, ev0 WHERE last_event_ts >= ev0.t - INTERVAL '7200 seconds'""".replace(
    "WITH g2 AS (", f"WITH {EVS}, g2 AS ("), TE)
def g11(spark, sf):
    t = g02(spark, sf)
    asof = C.events(spark, sf).agg(F.max("timestamp_utc").alias("__asof"))
    live = G.live_features(t.crossJoin(F.broadcast(asof)), F.col("__asof"), 7200)
    return live.drop("__asof")


@register("g11b_live_state", G2_SQL, TE)
def g11b(spark, sf):
    """The same features from state that expires 7,200 s after its last change (longer than this run takes)."""
    return _g2_out(on_log(spark, sf, "g11b", ST.live_features_state, ["user_id"], idle=False).select(
        *[F.col(c) if c != "latest_rating" else F.col(c).cast("int") for c in (
            "user_id", "interactions", "clicks", "completions", "latest_rating", "last_event_type", "last_event_ts", "ctr",
            "completion_rate")]))


@register("g12_checkpoint_restore", G2_SQL, TE)
def g12(spark, sf):
    """The first two deliveries, then a restart on the same checkpoint with the third: the state of the
    earlier run has to be there for the counts to be right."""
    return _g2_out(on_log(spark, sf, "g12", G.online_user_features, ["user_id"]))

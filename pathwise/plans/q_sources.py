"""Registered queries: contracts, sinks, metadata, upserts (A4-A14) and implicit interactions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pathwise.functions import constants as K
from pathwise.functions.expressions import scaled
from pathwise.operators import candidates as D
from pathwise.operators import contracts as CT
from pathwise.operators import events as EVT
from pathwise.operators import features as FT
from pathwise.plans import common as C
from pathwise.plans.catalog import register
from pathwise.plans.sqlparts import FEAT_CTE, clip as sc, scaled as sq
from pathwise.sources import io
from pathwise.streaming.feedback import new_run_dir


def _requests(spark, sf):
    l = C.learners(spark, sf)
    return l.select(
        "student_id", "attendance", "assignment_score", "quiz_score", "time_spent_hours", "attempts",
        "previous_score", F.lit(None).cast("double").alias("engagement_score"),
        ((F.col("attendance") + F.col("assignment_score")) / 2).alias("consistency_score"),
        F.when(F.col("student_id") % 50 == 0, "1.0").otherwise("2.0").alias("schema_version"))


def _req_reason_sql():
    parts = []
    for c, lo, hi, default in CT.PREDICT_SPEC:
        v = c if default is None else f"COALESCE(CAST({c} AS DOUBLE), {float(default)})"
        if default is None:
            parts.append(f"CASE WHEN {c} IS NULL THEN '{c}: missing' END")
        if lo is not None:
            parts.append(f"CASE WHEN {v} < {lo} THEN '{c}: below {lo}' END")
        if hi is not None:
            parts.append(f"CASE WHEN {v} > {hi} THEN '{c}: above {hi}' END")
    parts.append("CASE WHEN COALESCE(schema_version, '2.0') <> '2.0' THEN 'schema_version_mismatch' END")
    return f"concat_ws('; ', {', '.join(parts)})"


@register("a04_request_contract", f"""WITH r AS (
  SELECT student_id, attendance, assignment_score, quiz_score, time_spent_hours, attempts, previous_score,
         CAST(NULL AS DOUBLE) AS engagement_score, (attendance + assignment_score) / 2 AS consistency_score,
         CASE WHEN student_id % 50 = 0 THEN '1.0' ELSE '2.0' END AS schema_version FROM learners)
SELECT student_id, {_req_reason_sql()} AS reasons, {_req_reason_sql()} = '' AS is_valid,
       COALESCE(CAST(previous_score AS DOUBLE), 65.0) AS previous_score, COALESCE(engagement_score, 50.0) AS engagement_score
FROM r""", ("learners",))
def a04(spark, sf):
    v = CT.validate_request(_requests(spark, sf), CT.PREDICT_SPEC, version_col="schema_version")
    return v.select("student_id", F.array_join("reasons", "; ").alias("reasons"), "is_valid",
                    "previous_score", "engagement_score")


@register("a05_event_contract", f"""SELECT event_id,
  concat_ws('; ', CASE WHEN event_type NOT IN ({', '.join(repr(e) for e in K.EVENT_TYPES)}) OR event_type IS NULL
                       THEN 'event_type: not an allowed value' END,
                  CASE WHEN user_id IS NULL THEN 'user_id: missing' END) AS reasons,
  event_type IN ({', '.join(repr(e) for e in K.EVENT_TYPES)}) AND user_id IS NOT NULL AS is_valid,
  '{{}}' AS payload
FROM feedback_events""", ("feedback_events",))
def a05(spark, sf):
    v = CT.validate_events(C.events(spark, sf), now_col=F.col("timestamp_utc"))
    return v.select("event_id", F.array_join("reasons", "; ").alias("reasons"), "is_valid", "payload")


@register("a06_event_log_append", """SELECT event_id, event_type, CAST(timestamp_utc AS DATE) AS event_date
FROM feedback_events""", ("feedback_events",))
def a06(spark, sf):
    path = new_run_dir(spark, "a06") + "/events"
    ev = C.events(spark, sf)
    io.append_events(ev.filter(F.col("timestamp_utc") < F.lit("2024-01-16").cast("timestamp_ntz")), path)
    io.append_events(ev.filter(F.col("timestamp_utc") >= F.lit("2024-01-16").cast("timestamp_ntz")), path)
    return io.read_event_log(spark, path).select("event_id", "event_type", "event_date")


@register("a08_snapshot_sink")
def a08(spark, sf):
    path = new_run_dir(spark, "a08") + "/snapshots"
    ev = C.rated_events(spark, sf)
    io.write_snapshot(EVT.user_snapshot(ev, F.lit("2024-01-15").cast("timestamp_ntz")), path, "2024-01-15")
    io.write_snapshot(EVT.user_snapshot(ev), path, "2024-01-31")
    return spark.read.parquet(path)


@register("a09_write_back")
def a09(spark, sf):
    base = new_run_dir(spark, "a09")
    from pathwise.plans.jobs import analyze_learners
    out = io.write_version(analyze_learners(spark, sf), base, "v1")
    return spark.read.parquet(out)


@register("a11_metrics_sink")
def a11(spark, sf):
    path = new_run_dir(spark, "a11") + "/metrics"
    from pathwise.plans.q_eval import f22
    io.append_metrics(spark, path, "run-1", f22(spark, sf), "segment", ["hit", "precision", "recall", "ndcg"])
    return spark.read.parquet(path)


@register("a12_run_manifest")
def a12(spark, sf):
    path = new_run_dir(spark, "a12") + "/manifests"
    s = EVT.user_snapshot(C.rated_events(spark, sf)).agg(F.avg("ctr").alias("ctr"), F.count(F.lit(1)).alias("users")).first()
    io.append_manifest(spark, path, "20240101_000000", {"model": "rf"}, {"ctr": s["ctr"], "users": s["users"]}, {"k": 5})
    io.append_manifest(spark, path, "20240102_000000", {"model": "gbt"}, {"ctr": s["ctr"], "users": s["users"]}, {"k": 5})
    return io.latest_manifest(spark, path).select("version", "params", F.col("metrics")["users"].alias("users"))


_META = ["quiz_score", "engagement_score", "trend_momentum"]


@register("a13_preprocessing_metadata", f"""WITH {FEAT_CTE.strip()}
{' UNION ALL '.join(f"SELECT '{c}' AS col, {i} AS position, {sq(f'AVG({c})')} AS mean, {sq(f'CASE WHEN STDDEV_POP({c}) = 0 THEN 1.0 ELSE STDDEV_POP({c}) END')} AS std FROM feat" for i, c in enumerate(_META))}""",
          ("learners",))
def a13(spark, sf):
    p = FT.standard_params(C.features(spark, sf), _META)
    m = CT.preprocessing_metadata(p, _META)
    return m.select("col", "position", scaled("mean").alias("mean"), scaled("std").alias("std"))


_A14_SQL = f"""WITH {C.RATED_EVENTS_SQL},
old AS (SELECT CASE WHEN user_id % 10 = 0 THEN 'usr:' ELSE 'user:' END || CAST(user_id AS VARCHAR) AS entity,
               CAST(COUNT(*) AS BIGINT) AS interactions, MAX(timestamp_utc) AS last_event_ts,
               MAX(rating) AS latest_rating, TIMESTAMP '2024-01-16 00:00:00' AS written_at
        FROM ev WHERE timestamp_utc < TIMESTAMP '2024-01-16' GROUP BY user_id),
new AS (SELECT 'user:' || CAST(user_id AS VARCHAR) AS entity, CAST(COUNT(*) AS BIGINT) AS interactions,
               MAX(timestamp_utc) AS last_event_ts, MAX(rating) AS latest_rating, TIMESTAMP '2024-02-01 00:00:00' AS written_at
        FROM ev WHERE timestamp_utc >= TIMESTAMP '2024-01-16' GROUP BY user_id),
u AS (SELECT * FROM old UNION ALL SELECT * FROM new)
SELECT entity, arg_max(interactions, written_at) FILTER (WHERE interactions IS NOT NULL) AS interactions,
       arg_max(last_event_ts, written_at) FILTER (WHERE last_event_ts IS NOT NULL) AS last_event_ts,
       arg_max(latest_rating, written_at) FILTER (WHERE latest_rating IS NOT NULL) AS latest_rating,
       MAX(written_at) AS written_at
FROM u WHERE entity LIKE 'user:%' OR entity LIKE 'item:%' GROUP BY entity"""


@register("a14_online_feature_upsert", _A14_SQL, ("topics", "feedback_events"))
def a14(spark, sf):
    ev = C.rated_events(spark, sf)
    cut = F.lit("2024-01-16").cast("timestamp_ntz")

    def snap(e, prefix, written):
        return e.groupBy("user_id").agg(F.count(F.lit(1)).cast("bigint").alias("interactions"),
                                        F.max("timestamp_utc").alias("last_event_ts"),
                                        F.max("rating").alias("latest_rating")).select(
            F.concat(prefix, F.col("user_id").cast("string")).alias("entity"), "interactions", "last_event_ts",
            "latest_rating", F.lit(written).cast("timestamp_ntz").alias("written_at"))
    old = snap(ev.filter(F.col("timestamp_utc") < cut),
               F.when(F.col("user_id") % 10 == 0, F.lit("usr:")).otherwise(F.lit("user:")), "2024-01-16 00:00:00")
    new = snap(ev.filter(F.col("timestamp_utc") >= cut), F.lit("user:"), "2024-02-01 00:00:00")
    merged, _rejected = CT.online_feature_upsert(old, new, ["interactions", "last_event_ts", "latest_rating"])
    return merged


@register("d07_implicit_interactions", f"""WITH
l AS (SELECT student_id, subject_strength, subject_weakness, quiz_score,
        {sc('(0.35 * quiz_score + 0.25 * assignment_score + 0.20 * attendance + 0.20 * previous_score) / 100.0', 0.0, 1.0)} AS m,
        {sc('time_spent_hours / 8.0 + CAST(attempts AS DOUBLE) / 10.0', 0.2, 2.0)} AS e,
        {sc('(70.0 - quiz_score) / 20.0 + (65.0 - attendance) / 30.0 + (5.0 - LEAST(CAST(attempts AS DOUBLE), 5.0)) * 0.1', 0.2, 2.2)} AS need
      FROM learners),
cat AS (SELECT topic, topic_idx + 1 AS r FROM topics WHERE topic_idx < 5),
st AS (SELECT l.student_id, t.topic, t.rnk AS r, l.m, l.e, l.quiz_score FROM l JOIN topics t ON t.subject = l.subject_strength
       UNION ALL SELECT l.student_id, c.topic, c.r, l.m, l.e, l.quiz_score FROM l JOIN cat c ON true
       WHERE l.subject_strength IS NULL OR l.subject_strength NOT IN (SELECT subject FROM topics)),
wk AS (SELECT l.student_id, t.topic, t.rnk AS r, l.need FROM l JOIN topics t ON t.subject = l.subject_weakness
       UNION ALL SELECT l.student_id, c.topic, c.r, l.need FROM l JOIN cat c ON true
       WHERE l.subject_weakness IS NULL OR l.subject_weakness NOT IN (SELECT subject FROM topics))
SELECT student_id AS user_id, topic AS item_id, GREATEST((0.75 + m + e * 0.15) / r, 0.05) AS interaction_weight, 'strength' AS source
FROM st WHERE r <= 4
UNION ALL SELECT student_id, topic, GREATEST((0.90 + need) / r, 0.05), 'weakness' FROM wk WHERE r <= 4
UNION ALL SELECT student_id, topic, 0.35, 'extension' FROM st WHERE quiz_score >= 75 AND r BETWEEN 3 AND 5""",
          ("learners", "topics"))
def d07(spark, sf):
    return D.implicit_interactions(C.learners(spark, sf), C.topics(spark, sf))


@register("a01b_readers_with_quarantine", """
SELECT f.fmt, CAST(student_id AS VARCHAR) AS student_id, CASE WHEN student_id % 50 <> 0 THEN quiz_score END AS quiz_score,
  CASE WHEN student_id % 50 <> 0 THEN attempts END AS attempts, student_id % 50 = 0 AS quarantined
FROM learners, (VALUES ('csv'), ('json')) f(fmt)""", ("learners",))
def a01b(spark, sf):
    """CSV and JSON files in which every fiftieth learner's attempts are no number, read back with a quarantine."""
    path = new_run_dir(spark, "readers")
    names = [c for c in io.LEARNER_SCHEMA.names if c != "final_score"]
    schema = StructType([io.LEARNER_SCHEMA[c] for c in names])
    rows = C.learners(spark, sf).select(*[F.when(F.col("student_id") % 50 == 0, F.lit("many")).otherwise(F.col(c).cast("string")).alias(c)
                                          if c == "attempts" else F.col(c) for c in names])
    rows.write.option("header", True).csv(f"{path}/csv")
    numbers = rows.withColumn("student_id", F.col("student_id").cast("string"))
    as_json = F.when(F.col("attempts") == "many", F.to_json(F.struct(*names))).otherwise(F.to_json(F.struct(
        *[F.col(c).cast("int").alias(c) if c == "attempts" else F.col(c) for c in names])))
    numbers.select(as_json.alias("value")).write.text(f"{path}/json")
    out = None
    for fmt, key in (("csv", F.split("record", ",")[0]), ("json", F.get_json_object("record", "$.student_id"))):
        good, bad = io.read_checked(spark, f"{path}/{fmt}", fmt, schema, f"{path}/staged-{fmt}")
        both = good.select(F.lit(fmt).alias("fmt"), "student_id", "quiz_score", "attempts", F.lit(False).alias("quarantined")).unionByName(
            bad.select(F.lit(fmt).alias("fmt"), key.alias("student_id"), F.lit(None).cast("double").alias("quiz_score"),
                       F.lit(None).cast("int").alias("attempts"), F.lit(True).alias("quarantined")))
        out = both if out is None else out.unionByName(both)
    return out

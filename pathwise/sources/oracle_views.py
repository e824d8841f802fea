"""SQL text of the three fixture views, for the DuckDB oracle.

The text is plain ANSI SQL and runs unchanged in DuckDB and Spark SQL; the
Spark side builds the same views with the DataFrame API
(``pathwise.sources.tables``), so the oracle is an independent rendering.
"""

LEARNERS_SQL = """
WITH o AS (
  SELECT o_custkey, COUNT(*) AS n_orders,
         SUM(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) AS n_open
  FROM orders GROUP BY o_custkey),
l AS (
  SELECT o_custkey, COUNT(*) AS n_lines,
         SUM(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS n_kept,
         SUM(CAST(l_quantity AS BIGINT)) AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey),
t AS (
  SELECT o_custkey, p_type, COUNT(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                JOIN part ON l_partkey = p_partkey
  GROUP BY o_custkey, p_type),
r AS (
  SELECT o_custkey, p_type,
         ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY n DESC, p_type) AS hi,
         ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY n, p_type DESC) AS lo
  FROM t)
SELECT c_custkey AS student_id,
  CAST(14 + c_nationkey % 11 AS INT) AS age,
  CASE c_custkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Other' END AS gender,
  c_mktsegment AS learning_style,
  CAST(n_open AS DOUBLE) * 100 / n_orders AS attendance,
  CAST(n_kept AS DOUBLE) * 100 / n_lines AS assignment_score,
  (c_acctbal + 1000) / 110 AS quiz_score,
  LEAST(GREATEST(CAST(n_lines AS DOUBLE) / 10, CAST(0.5 AS DOUBLE)), CAST(15 AS DOUBLE)) AS time_spent_hours,
  CAST(1 + n_orders % 9 AS INT) AS attempts,
  CAST(qty AS DOUBLE) * 2 / n_lines AS previous_score,
  CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS internet_access,
  CASE WHEN c_custkey % 5 < 2 THEN 0 ELSE 1 END AS extracurricular,
  CASE WHEN c_custkey % 10 < 2 THEN 'Low' WHEN c_custkey % 10 < 7 THEN 'Medium' ELSE 'High' END AS parental_support,
  CASE WHEN c_nationkey % 10 < 3 THEN 'Low' WHEN c_nationkey % 10 < 7 THEN 'Medium' ELSE 'High' END AS stress_level,
  s1.p_type AS subject_strength, w1.p_type AS subject_weakness
FROM customer
LEFT JOIN o ON c_custkey = o.o_custkey
LEFT JOIN l ON c_custkey = l.o_custkey
LEFT JOIN r s1 ON c_custkey = s1.o_custkey AND s1.hi = 1
LEFT JOIN r w1 ON c_custkey = w1.o_custkey AND w1.lo = 1
"""

TOPICS_SQL = """
SELECT p_type AS subject, CONCAT(p_type, ' ', p_brand) AS topic, rnk,
       CAST(ROW_NUMBER() OVER (ORDER BY p_type, rnk) - 1 AS INT) AS topic_idx
FROM (SELECT p_type, p_brand,
             CAST(ROW_NUMBER() OVER (PARTITION BY p_type ORDER BY p_brand) AS INT) AS rnk
      FROM (SELECT DISTINCT p_type, p_brand FROM part) d) x
"""

FEEDBACK_EVENTS_SQL = """
SELECT event_id, ts AS timestamp_utc, user_id,
  CASE event_type WHEN 'view' THEN 'recommendation_shown' WHEN 'click' THEN 'recommendation_clicked'
                  WHEN 'signup' THEN 'lesson_started' WHEN 'purchase' THEN 'lesson_completed'
                  ELSE event_type END AS event_type,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % (SELECT COUNT(*) FROM (SELECT DISTINCT p_type, p_brand FROM part) pt) AS topic_idx,
  CONCAT(CAST(user_id AS VARCHAR(20)), ':', CAST(CAST(ts AS DATE) AS VARCHAR(10))) AS session_id,
  value
FROM events
"""

VIEWS = {
    "learners": LEARNERS_SQL,
    "topics": TOPICS_SQL,
    "feedback_events": FEEDBACK_EVENTS_SQL,
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for the named fixture views (in order)."""
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = sql.strip()
    if body[:5].upper() in ("WITH ", "WITH\n"):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"

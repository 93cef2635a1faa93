"""p1: sessions of authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.names import plain
from millrace.operators.sessions import merge_deliveries, sessionize
from millrace.sources.tables import table


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    tweets = merge_deliveries(table(spark, d, "tweet"), "id", plain("author"), "date_created")
    return sessionize(tweets, "_user", "_at", "_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).select(F.col("user_key").alias("author"), "first_id", "last_id")


def p1_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Every session with start, end, duration and number of tweets."""
    return _sessions(spark, d).select(F.col("user_key").alias("author"), "session_no", "first_id", "last_id", "start_at", "end_at", "duration_s", "n_events")


def p1_event_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The same operator over the event stream table, by user_id."""
    return sessionize(table(spark, d, "events"), "user_id", "ts", "event_id").select(F.col("user_key").alias("user_id"), "session_no", "first_id", "last_id", "n_events")


_NUMBERED = """
t AS (
  SELECT id, min(lower(trim(regexp_replace(trim(author), '^[@#]+', '')))) AS author, min(date_created) AS tm
  FROM tweet WHERE id IS NOT NULL GROUP BY id
  HAVING min(author) IS NOT NULL AND min(date_created) IS NOT NULL
),
f AS (
  SELECT *, CASE WHEN tm > lag(tm) OVER w + INTERVAL 30 MINUTE OR lag(tm) OVER w IS NULL THEN 1 ELSE 0 END AS brk
  FROM t WINDOW w AS (PARTITION BY author ORDER BY tm, id)
),
s AS (SELECT *, sum(brk) OVER (PARTITION BY author ORDER BY tm, id ROWS UNBOUNDED PRECEDING) AS no FROM f)
"""

QUERIES = {"p1_found": p1_found, "p1_sessions": p1_sessions, "p1_event_sessions": p1_event_sessions}

ORACLES = {
    "p1_found": f"WITH {_NUMBERED} SELECT author, first(id ORDER BY tm, id) AS first_id, last(id ORDER BY tm, id) AS last_id FROM s GROUP BY author, no",
    "p1_sessions": f"""WITH {_NUMBERED} SELECT author, CAST(no AS BIGINT) AS session_no, first(id ORDER BY tm, id) AS first_id,
        last(id ORDER BY tm, id) AS last_id, min(tm) AS start_at, max(tm) AS end_at,
        (epoch_us(max(tm)) - epoch_us(min(tm))) / 1e6 AS duration_s, count(*) AS n_events FROM s GROUP BY author, no""",
    "p1_event_sessions": """WITH f AS (
        SELECT event_id, user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS brk
        FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS no FROM f)
      SELECT user_id, CAST(no AS BIGINT) AS session_no, first(event_id ORDER BY ts, event_id) AS first_id,
        last(event_id ORDER BY ts, event_id) AS last_id, count(*) AS n_events FROM s GROUP BY user_id, no""",
}

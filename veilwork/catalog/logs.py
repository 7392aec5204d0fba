"""Chat, policy and audit log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.textnorm import parse_time
from ..operators.logs import (guest_quota, latest, recent_messages, retention_filter, session_activity,
                              session_audit)
from .base import query


@query("recent_messages_per_user", """SELECT user_id, conv_id, turn, role, text, CAST(row_number() OVER (PARTITION BY user_id ORDER BY conv_id, turn) AS INT) AS position FROM (
  SELECT *, CASE WHEN conv_id % 3 > 0 THEN conv_id % 20 END AS user_id FROM conversations
  QUALIFY row_number() OVER (PARTITION BY CASE WHEN conv_id % 3 > 0 THEN conv_id % 20 END ORDER BY conv_id DESC, turn DESC) <= 5)""")
def recent(t):
    messages = t.conversations.withColumn("user_id", F.expr("IF(conv_id % 3 > 0, conv_id % 20, NULL)"))
    return recent_messages(messages, "user_id", ["conv_id", "turn"], 5)


_TIME = "CASE event_id % 10 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE replace(substr(CAST(ts AS STRING), 1, 19), ' ', 'T') || 'Z' END"


@query("retention_filter", """SELECT event_id FROM events WHERE event_id % 10 < 2
  OR date_trunc('second', ts) >= TIMESTAMP '2024-01-25 00:00:00' - INTERVAL 15 DAY""")
def retained(t):
    messages = t.events.select("event_id", F.expr(_TIME).alias("created_at"))
    as_of = F.expr("TIMESTAMP '2024-01-25 00:00:00'")
    return retention_filter(messages, parse_time(F.col("created_at")), as_of).select("event_id")


@query("guest_quota", """SELECT event_id, user_id, n AS message_no, CASE WHEN n > 15 THEN 'refused' WHEN n - 1 IN (4, 10) THEN 'warn' ELSE 'ok' END AS status
FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) AS n FROM (
  SELECT event_id, CASE WHEN event_id % 4 > 0 THEN user_id END AS user_id, CASE WHEN event_id % 9 > 0 THEN ts END AS ts FROM events))""")
def quota(t):
    """Every fourth message is a guest's without a name, every ninth has no time."""
    messages = t.events.select("event_id", F.expr("IF(event_id % 4 > 0, user_id, NULL)").alias("user_id"),
                               F.expr("IF(event_id % 9 > 0, CAST(ts AS TIMESTAMP), NULL)").alias("ts"))
    return guest_quota(messages, "user_id", "ts", "event_id").drop("ts")


@query("latest_policy_events", """SELECT o_orderkey AS id, o_custkey AS user_id, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders
ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100""")
def newest(t):
    events = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                             F.col("o_orderdate").alias("created_at"))
    return latest(events, "created_at", "id").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd"))


_KIND = "CASE event_type WHEN 'click' THEN 'session_start' WHEN 'view' THEN 'sessionXend' WHEN 'error' THEN 'user_logout' WHEN 'signup' THEN 'my_session_x' ELSE event_type END"


@query("session_audit", f"SELECT event_id, user_id, {_KIND} AS event_type FROM events WHERE event_type IN ('click', 'view', 'error')")
def audit(t):
    rows = t.events.select("event_id", "user_id", F.expr(_KIND).alias("event_type"), "ts")
    return session_audit(rows).orderBy(F.col("ts").desc(), "event_id").drop("ts")


@query("list_users", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS role FROM customer ORDER BY c_custkey")
def users(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                             F.col("c_mktsegment").alias("role")).orderBy("id")


@query("session_activity", """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 8 HOUR THEN 0 ELSE 1 END AS opens FROM events),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start,
  strftime(max(ts) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS events FROM n GROUP BY ALL""")
def sessions(t):
    done = session_activity(t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts")
    return done.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("session_start", "session_end")})

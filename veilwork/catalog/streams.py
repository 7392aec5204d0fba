"""Streams over the given tables, run to their end; checked against the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.decisions import decide
from ..functions.detection import with_findings
from ..streaming.gateway import (action_counts, analyze_stream, policy_event_stream, read_table_stream,
                                 run_to_table, session_stream)
from ..session import fresh_dir
from ..sources.appends import append_stream, read_appended
from ..streaming.quota import guest_quota_stream
from ..streaming.scores import attach_score_stream, decide_scored
from .base import query
from .decisions import POLICY
from .finding_sql import ACTION_SQL, findings_sql, flags_sql, merged_sql

_TEXTS = "texts AS (SELECT doc_id AS id, text FROM documents)"
_ANALYSIS = f"WITH RECURSIVE {_TEXTS}, {findings_sql('texts')}, {merged_sql('texts')}, {flags_sql('texts', POLICY)}"


def _documents(t):
    return read_table_stream(t.spark, t.folder, "documents").select(F.col("doc_id").alias("id"), "text")


@query("stream_gateway", f"""{_ANALYSIS} SELECT id, {ACTION_SQL} AS action, CASE WHEN {ACTION_SQL} = 'mask' THEN out END AS masked_output
FROM texts JOIN masked USING (id) JOIN flags USING (id)""")
def gateway(t):
    return run_to_table(analyze_stream(_documents(t)).select("id", "action", "masked_output"), "gateway")


@query("stream_policy_events", f"""{_ANALYSIS} SELECT id, CASE {ACTION_SQL} WHEN 'mask' THEN 'chat_message_masked' WHEN 'block' THEN 'chat_message_blocked' ELSE 'chat_message' END AS policy_id,
  CASE {ACTION_SQL} WHEN 'block' THEN '[BLOCKED BY POLICY]' WHEN 'mask' THEN coalesce(nullif(out, ''), '[MASKED]') ELSE text END AS safe_text
FROM texts JOIN masked USING (id) JOIN flags USING (id)""")
def events(t):
    """Events appended micro-batch by micro-batch, each once."""
    path, state = fresh_dir(t.spark, "policy-events"), fresh_dir(t.spark, "policy-events-state")
    append_stream(policy_event_stream(_documents(t)).select("id", "policy_id", "safe_text"), path, state, "events")
    return read_appended(t.spark, path, "id BIGINT, policy_id STRING, safe_text STRING")


def _events(t):
    return read_table_stream(t.spark, t.folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_guest_quota", """SELECT event_id, user_id, n AS message_no, CASE WHEN n > 15 THEN 'refused' WHEN n - 1 IN (4, 10) THEN 'warn' ELSE 'ok' END AS status
FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (
  SELECT event_id, CASE WHEN event_id % 4 > 0 THEN user_id END AS user_id, ts FROM events))""")
def quota(t):
    messages = _events(t).select("event_id", F.expr("IF(event_id % 4 > 0, user_id, NULL)").alias("user_id"), "ts")
    return run_to_table(guest_quota_stream(messages, "user_id", "ts", "event_id"), "quota").drop("ts")


# A score per message but for every fifth; every seventh comes an hour late, every ninth before its message.
_SCORED = "event_id % 5 <> 0"
_DELAY = "CASE WHEN event_id % 7 = 0 THEN 3600 WHEN event_id % 9 = 0 THEN -30 ELSE event_id % 500 END"
_SCORE = "round(CAST(event_id % 997 AS DOUBLE) / 997, 6)"


@query("stream_scores", f"""SELECT event_id, user_id, s AS score, CASE WHEN s IS NULL THEN 'failed' ELSE 'ok' END AS scan_status,
  CASE WHEN s >= 0.8 THEN 'block' WHEN s IS NOT NULL THEN 'allow' ELSE 'block' END AS action FROM (
  SELECT event_id, user_id, CASE WHEN {_SCORED} AND {_DELAY} BETWEEN -60 AND 600 THEN {_SCORE} END AS s FROM events)""")
def scored(t):
    """Messages and their scores as two streams of files; late and missing scores give the fail-closed default.

    Both streams end with a row far in the future, which tells that nothing more will come.
    """
    rows = t.events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), F.lit(0).cast("long").alias("user_id"), "ts")
    later = F.col("ts") + F.expr(f"make_dt_interval(0, 0, 0, {_DELAY})")
    scores = rows.filter(_SCORED).select("event_id", later.alias("scored_at"), F.expr(_SCORE).alias("score"))
    last = end.select("event_id", F.col("ts").alias("scored_at"), F.lit(0.0).alias("score"))
    streams = []
    for name, part, closing, at in (("messages", rows, end, "ts"), ("scores", scores, last, "scored_at")):
        path = fresh_dir(t.spark, name)
        half = F.expr("TIMESTAMP '2024-01-15 00:00:00'")
        for piece in (part.filter(F.col(at) < half), part.filter(F.col(at) >= half), closing):
            piece.write.mode("append").parquet(path)
        streams.append(t.spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(path))
    joined = attach_score_stream(*streams, "event_id", "ts", "scored_at", "score", late="40 days")
    done = run_to_table(decide_scored(joined, "score", 0.8), "scored")
    return done.filter("event_id >= 0").select("event_id", "user_id", "score", "scan_status", "action")


@query("stream_sessions", """WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 8 HOUR THEN 0 ELSE 1 END AS opens FROM events),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS session_start, strftime(max(ts) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS session_end, count(*) AS events
FROM n GROUP BY user_id, session_no HAVING max(ts) + INTERVAL 8 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def sessions(t):
    """Closed sessions only: those that end before the watermark of the last event."""
    done = run_to_table(session_stream(_events(t), "user_id", "ts"), "sessions")
    return done.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("session_start", "session_end")})


_KIND = "CASE event_type WHEN 'click' THEN 'mail ' || CAST(user_id AS STRING) || 'a@ex.com' WHEN 'error' THEN 'key AKIA' || upper(substr(md5(CAST(event_id AS STRING)), 1, 16)) ELSE event_type END"


@query("stream_action_counts", """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  CASE event_type WHEN 'click' THEN 'mask' WHEN 'error' THEN 'block' ELSE 'allow' END AS action, count(*) AS n FROM events
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""")
def counts(t):
    """Closed windows only: those that end before the watermark of the last event."""
    messages = _events(t).select("ts", F.expr(_KIND).alias("text"))
    decided = with_findings(messages, "text", "f").select("ts", decide(F.col("f")).alias("action"))
    done = run_to_table(action_counts(decided, "ts"), "action-counts")
    return done.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))

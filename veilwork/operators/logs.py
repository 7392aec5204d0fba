"""Questions to the chat, policy and audit logs, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranking import first_per_key, running_rank

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
RECENT_MESSAGES = 50
HISTORY_DAYS = 15
GUEST_LIMIT = 15
WARN_AT = [4, 10]
LATEST_EVENTS = 100
SESSION_HOURS = 8
# ---------------------------------------------------------------------------


def recent_messages(messages: DataFrame, user: str, order: list[str], n: int = RECENT_MESSAGES) -> DataFrame:
    """The last n messages of every user, guests being one group; `position` 1 is the oldest shown."""
    newest = first_per_key(messages, [user], [F.col(c).desc() for c in order], n, "_age")
    shown = F.count(F.lit(1)).over(Window.partitionBy(user))
    return newest.withColumn("position", (shown - F.col("_age") + 1).cast("int")).drop("_age")


def retention_filter(messages: DataFrame, at: Column, as_of: Column, days: int = HISTORY_DAYS) -> DataFrame:
    """Messages of the last days; a missing or unreadable time keeps the message."""
    return messages.filter(at.isNull() | (at >= as_of - F.make_dt_interval(F.lit(days))))


def guest_quota(messages: DataFrame, guest: str, at: str, key: str, limit: int = GUEST_LIMIT) -> DataFrame:
    """Running message number per guest, and ok / warn / refused.

    A guest's messages are numbered within hours and shifted by the hours before, so one
    very busy guest is not one task.
    """
    numbered = running_rank(messages, [guest], [F.col(at), F.col(key)], F.date_trunc("hour", at), "message_no")
    before = F.col("message_no") - 1
    status = F.when(F.col("message_no") > limit, "refused").when(before.isin(*WARN_AT), "warn").otherwise("ok")
    return numbered.withColumn("status", status)


def latest(events: DataFrame, at: str, key: str, n: int = LATEST_EVENTS) -> DataFrame:
    return events.orderBy(F.col(at).desc(), F.col(key).desc()).limit(n)


def session_audit(audit: DataFrame) -> DataFrame:
    """Session events and logouts; the underscore of the pattern stands for any character."""
    kind = F.col("event_type")
    return audit.filter(kind.like("session_%") | (kind == "user_logout"))


def session_activity(events: DataFrame, user: str, at: str, hours: int = SESSION_HOURS) -> DataFrame:
    """Sessions: activity whose gaps are shorter than the sliding expiry.

    Events of one user and hour always belong together, so they are summed first; the
    windows then see at most one row per user and hour.
    """
    hourly = events.groupBy(user, F.date_trunc("hour", at).alias("_hour")).agg(
        F.min(at).alias("_first"), F.max(at).alias("_last"), F.count(F.lit(1)).alias("_n"))
    by_user = Window.partitionBy(user).orderBy("_hour")
    gap = F.make_dt_interval(F.lit(0), F.lit(hours))
    previous = F.lag("_last").over(by_user)
    opens = F.when(previous.isNull() | (F.col("_first") >= previous + gap), 1).otherwise(0)
    numbered = hourly.withColumn("_opens", opens).withColumn(
        "session_no", F.sum("_opens").over(by_user.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(user, "session_no").agg(
        F.min("_first").alias("session_start"), (F.max("_last") + gap).alias("session_end"),
        F.sum("_n").alias("events"))

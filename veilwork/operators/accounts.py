"""Users, sessions and tokens as tables: each change is a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .cleaning import email_key


def active_sessions(users: DataFrame, sessions: DataFrame, as_of: Column) -> DataFrame:
    """Users of the sessions that have not expired. Expired rows go before the join."""
    live = sessions.filter(F.col("expires_at") > as_of)
    return live.join(users, F.col("user_id") == F.col("id")).select("id", "name", "role", "token", "expires_at")


def valid_tokens(tokens: DataFrame, presented: DataFrame, as_of: Column) -> DataFrame:
    """Stored tokens that were presented in time."""
    return tokens.filter(F.col("expires_at") > as_of).join(presented.select("token"), "token", "left_semi")


def verify_users(users: DataFrame, used: DataFrame) -> DataFrame:
    """Users with is_verified set for those who used a valid token."""
    who = used.select(F.col("user_id").alias("id")).distinct().withColumn("_used", F.lit(1))
    return users.join(who, "id", "left").withColumn(
        "is_verified", F.when(F.col("_used") == 1, 1).otherwise(F.col("is_verified"))).drop("_used")


def without_used(tokens: DataFrame, used: DataFrame) -> DataFrame:
    """Each token is good once."""
    return tokens.join(used.select("token"), "token", "left_anti")


def without_users(rows: DataFrame, erased: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Rows of erased users go (sessions, tokens, the users themselves)."""
    return rows.join(erased.select(F.col("id").alias(user_col)), user_col, "left_anti")


def detach_users(rows: DataFrame, erased: DataFrame, user_col: str = "user_id") -> DataFrame:
    """Rows of erased users stay without their user (chat, audit and policy logs)."""
    gone = erased.select(F.col("id").alias(user_col), F.lit(True).alias("_gone"))
    return rows.join(gone, user_col, "left").withColumn(
        user_col, F.when(F.col("_gone").isNull(), F.col(user_col))).drop("_gone")


def apply_role_changes(users: DataFrame, changes: DataFrame) -> DataFrame:
    """The last change per user (by change_no) wins; users without one keep their role."""
    last = changes.groupBy(F.col("user_id").alias("id")).agg(F.max_by("new_role", "change_no").alias("_new"))
    return users.join(last, "id", "left").withColumn("role", F.coalesce("_new", "role")).drop("_new")


def lookup_by_email(users: DataFrame, asked: DataFrame) -> DataFrame:
    """User id per asked address, null if unknown; both sides are compared in normal form."""
    known = users.select(email_key(F.col("email")).alias("_key"), F.col("id").alias("user_id"))
    return asked.withColumn("_key", email_key(F.col("email"))).join(known, "_key", "left").drop("_key")

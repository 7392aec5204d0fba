"""Append-only log tables and metric files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.textnorm import first_text


def chat_message_rows(df: DataFrame, user_id: Column, role: Column, content: Column, at: Column) -> DataFrame:
    """user_id (null for a guest), role, content, created_at."""
    return df.select(user_id.alias("user_id"), role.alias("role"), content.alias("content"),
                     at.alias("created_at"))


def audit_event_rows(df: DataFrame, user_id: Column, event_type: Column, data: Column, at: Column) -> DataFrame:
    """Event data as JSON text; missing data is an empty object."""
    return df.select(user_id.alias("user_id"), event_type.alias("event_type"),
                     F.coalesce(F.to_json(data), F.lit("{}")).alias("event_data"), at.alias("created_at"))


def policy_event_log(df: DataFrame, user_id: Column, policy_id: Column, action: Column, found: Column,
                     ip: Column, user_agent: Column, raw: Column, at: Column) -> DataFrame:
    """Findings as a JSON array (missing: empty), raw content never null."""
    names = F.coalesce(found, F.array().cast("array<string>"))
    return df.select(
        user_id.alias("user_id"), policy_id.alias("policy_id"), action.alias("action"),
        F.to_json(names).alias("findings"), ip.alias("ip_address"), user_agent.alias("user_agent"),
        F.coalesce(raw, F.lit("")).alias("raw_content"), at.alias("created_at"))


# ---------------------------------------------------------------------------
# Request headers that name the client, first one wins.
# ---------------------------------------------------------------------------
CLIENT_HEADERS = [
    "x-forwarded-for", "cf-connecting-ip", "true-client-ip", "x-real-ip", "x-client-ip",
    "fastly-client-ip", "x-cluster-client-ip", "remote-addr", "remote-address",
]
# ---------------------------------------------------------------------------


def header(headers: Column, name: str) -> Column:
    """A header's value by its name in lower case; of several spellings the last counts."""
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.try_element_at(found, F.lit(-1))["value"]


def client_ip(headers: Column) -> Column:
    """Client address from a header map of any letter case; `unknown` if there is none."""
    direct = first_text(*[header(headers, h) for h in CLIENT_HEADERS])
    forwarded = F.regexp_extract(header(headers, "forwarded"), r"(?i)(?:^|;)\s*for=([^;]*)", 1)
    forwarded = F.btrim(F.btrim(F.trim(forwarded), F.lit('"')), F.lit("[]"))
    ip = first_text(direct, forwarded)
    first = F.when(F.contains(ip, F.lit(",")), F.trim(F.split(ip, ",", -1)[0])).otherwise(ip)
    return F.coalesce(F.nullif(first, F.lit("")), F.lit("unknown"))


def client_agent(headers: Column) -> Column:
    return F.coalesce(header(headers, "user-agent"), F.lit("unknown"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows (metric, value) as one JSON-lines table."""
    metrics.write.mode("overwrite").json(path)

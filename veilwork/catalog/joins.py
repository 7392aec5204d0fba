"""Relabelling, account changes and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.detection import long_findings
from ..operators.accounts import (active_sessions, apply_role_changes, detach_users, lookup_by_email, valid_tokens,
                                  verify_users, without_used, without_users)
from ..operators.containment import relabel_by_containment
from .base import query
from .finding_sql import findings_sql


@query("relabel_by_containment", """SELECT doc_id, CAST(EXISTS (SELECT 1 FROM benchmark b WHERE trim(b.text) <> '' AND contains(d.text, trim(b.text))) AS INT) AS label FROM documents d""")
def contained(t):
    return relabel_by_containment(t.documents.select("doc_id", "text"), t.benchmark, "doc_id", match="text")


_WEB = """web AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'p' || CAST(page_id AS VARCHAR), html FROM pages)"""


@query("relabel_by_scan", f"""WITH {_WEB}, {findings_sql('web')}, known AS (SELECT DISTINCT trim(match) AS m FROM found WHERE category = 'Secret')
SELECT id, CAST(EXISTS (SELECT 1 FROM known WHERE contains(web.text, m)) AS INT) AS label FROM web""")
def scanned(t):
    web = t.documents.select(F.expr("'d' || CAST(doc_id AS STRING)").alias("id"), "text").unionByName(
        t.pages.select(F.expr("'p' || CAST(page_id AS STRING)").alias("id"), F.col("html").alias("text")))
    secrets = long_findings(web, "id").filter(F.col("category") == "Secret")
    return relabel_by_containment(web, secrets, "id")


_AS_OF = "TIMESTAMP '1998-01-01 04:00:00'"


def _users(t):
    return t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                             F.expr("IF(c_mktsegment = 'MACHINERY', 'admin', 'user')").alias("role"),
                             F.lit(0).alias("is_verified"))


def _sessions(t):
    return t.orders.select(F.expr("md5(CAST(o_orderkey AS STRING))").alias("token"), F.col("o_custkey").alias("user_id"),
                           F.expr("CAST(o_orderdate AS TIMESTAMP) + INTERVAL '8' HOUR").alias("expires_at"), "o_orderstatus")


_SESSIONS_SQL = """sessions AS (SELECT md5(CAST(o_orderkey AS VARCHAR)) AS token, o_custkey AS user_id, o_orderdate + INTERVAL 8 HOUR AS expires_at, o_orderstatus FROM orders),
users AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'user' END AS role, c_acctbal FROM customer)"""


@query("active_sessions", f"""WITH {_SESSIONS_SQL} SELECT u.id, name, role, token, strftime(expires_at, '%Y-%m-%d %H:%M:%S') AS expires_at
FROM users u JOIN sessions s ON s.user_id = u.id WHERE expires_at > {_AS_OF}""")
def active(t):
    live = active_sessions(_users(t), _sessions(t), F.expr(_AS_OF))
    return live.withColumn("expires_at", F.date_format("expires_at", "yyyy-MM-dd HH:mm:ss"))


@query("consume_tokens", f"""WITH {_SESSIONS_SQL}, used AS (SELECT * FROM sessions WHERE expires_at > {_AS_OF} AND o_orderstatus = 'F')
SELECT 'user' AS kind, CAST(id AS VARCHAR) AS key, CASE WHEN id IN (SELECT user_id FROM used) THEN 1 ELSE 0 END AS is_verified FROM users
UNION ALL SELECT 'token', token, NULL FROM sessions WHERE token NOT IN (SELECT token FROM used)""")
def consumed(t):
    tokens = _sessions(t)
    used = valid_tokens(tokens, tokens.filter("o_orderstatus = 'F'"), F.expr(_AS_OF))
    users = verify_users(_users(t), used).select(F.lit("user").alias("kind"), F.col("id").cast("string").alias("key"), "is_verified")
    left = without_used(tokens, used).select(F.lit("token").alias("kind"), F.col("token").alias("key"),
                                             F.lit(None).cast("int").alias("is_verified"))
    return users.unionByName(left)


@query("erase_users", f"""WITH {_SESSIONS_SQL}, erased AS (SELECT id FROM users WHERE c_acctbal < 0)
SELECT 'user' AS kind, id AS key, id AS user_id FROM users WHERE id NOT IN (SELECT id FROM erased)
UNION ALL SELECT 'session', o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT id FROM erased)
UNION ALL SELECT 'event', event_id, CASE WHEN user_id NOT IN (SELECT id FROM erased) THEN user_id END FROM events""")
def erased(t):
    gone = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("id"))
    users = without_users(t.customer.select(F.col("c_custkey").alias("user_id")), gone)
    sessions = without_users(t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("user_id")), gone)
    events = detach_users(t.events.select(F.col("event_id").alias("key"), "user_id"), gone)
    return users.select(F.lit("user").alias("kind"), F.col("user_id").alias("key"), "user_id").unionByName(
        sessions.select(F.lit("session").alias("kind"), "key", "user_id")).unionByName(
        events.select(F.lit("event").alias("kind"), "key", "user_id"))


@query("apply_role_changes", f"""WITH {_SESSIONS_SQL}, last AS (SELECT o_custkey AS id, arg_max(CASE WHEN o_orderstatus = 'F' THEN 'admin' ELSE 'user' END, o_orderkey) AS r
  FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) SELECT u.id, name, coalesce(r, role) AS role FROM users u LEFT JOIN last USING (id)""")
def roles(t):
    changes = t.orders.filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("change_no"),
        F.expr("IF(o_orderstatus = 'F', 'admin', 'user')").alias("new_role"))
    return apply_role_changes(_users(t), changes).select("id", "name", "role")


@query("lookup_user_by_email", """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN c_custkey END AS user_id FROM events LEFT JOIN customer ON c_custkey = user_id""")
def by_email(t):
    users = t.customer.select(F.col("c_custkey").alias("id"), F.expr("'  User' || CAST(c_custkey AS STRING) || '@Ex.com'").alias("email"))
    asked = t.events.select("event_id", F.expr("IF(user_id % 2 = 0, 'uSER', 'nobody') || CAST(user_id AS STRING) || '@EX.com '").alias("email"))
    return lookup_by_email(users, asked).select("event_id", "user_id")


@query("union_all", """SELECT text, 'document' AS kind FROM documents UNION ALL SELECT text, 'benchmark' FROM benchmark
UNION ALL SELECT text, 'turn' FROM conversations""")
def union_all(t):
    return t.documents.select("text", F.lit("document").alias("kind")).unionByName(
        t.benchmark.select("text", F.lit("benchmark").alias("kind"))).unionByName(
        t.conversations.select(F.lit("turn").alias("kind"), "text"))

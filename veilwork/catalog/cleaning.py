"""Cleaning operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.textnorm import parse_epoch, parse_time
from ..operators.cleaning import (align_schema, coalesce_text, display_fields, drop_incomplete,
                                  keyword_filter, label_encode, min_words, normalize_spans, policy_event_view,
                                  sample_preview, select_splits, unique_emails, with_record_id)
from ..operators.ranking import hash_order
from ..session import fresh_dir
from ..sources.jsonl import parse_lines
from ..sources.lines import numbered_lines
from ..sources.sinks import client_agent, client_ip
from ..sources.tables import ranged
from .base import LABELLED_SQL, hash_sql, query

_FIELDS = ["doc_id", "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN text END AS text",
           "CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS content", "CASE WHEN doc_id % 5 = 0 THEN source END AS article"]


@query("coalesce_text", f"""SELECT doc_id, CASE WHEN text <> '' THEN text WHEN content <> '' THEN content ELSE article END AS text
FROM (SELECT {', '.join(_FIELDS)} FROM documents) WHERE text <> '' OR content <> '' OR article <> ''""")
def coalesced(t):
    return coalesce_text(t.documents.selectExpr(*_FIELDS))


_STRIPPED = "regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')"
_WORDS = "len(regexp_extract_all(text, '\\S+'))"


@query("min_words_filter", f"SELECT doc_id, {_STRIPPED} AS text FROM documents WHERE {_WORDS} >= 5")
def words(t):
    return min_words(t.documents.select("doc_id", "text"))


@query("assign_record_id", f"""SELECT id, text FROM (SELECT lang || '_' || CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS VARCHAR) AS id,
  {_STRIPPED} AS text, {_WORDS} AS n FROM documents) WHERE n >= 5""")
def record_ids(t):
    """Ids from the physical lines of each split's files, really written; short texts are dropped after they are numbered."""
    path = fresh_dir(t.spark, "splits")
    rows = t.documents.select("lang", "doc_id", F.to_json(F.struct("text")).alias("value"))
    ranged(rows, "lang", "doc_id").drop("doc_id").write.partitionBy("lang").text(path)
    lines = numbered_lines(t.spark, path, by="folder").withColumn("split", F.url_decode(F.regexp_extract("file", "/lang=([^/]*)/", 1)))
    parsed = parse_lines(with_record_id(lines, "split", "line_no").select("id", "value"), F.col("value"), "text STRING")
    return min_words(parsed.select("id", "text"))


@query("constant_label", "SELECT doc_id, 'unsafe' AS label, 0 AS y FROM documents")
def constant(t):
    return t.documents.select("doc_id", F.lit("unsafe").alias("label"), F.lit(0).alias("y"))


_SPLIT = "CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' WHEN 2 THEN 'test' END"


@query("select_splits", f"SELECT doc_id, {_SPLIT} AS split FROM documents WHERE doc_id % 4 < 2")
def splits(t):
    return select_splits(t.documents.select("doc_id", F.expr(_SPLIT).alias("split")), "split")


_KEYED = "CASE doc_id % 9 WHEN 0 THEN text || ' Phone' WHEN 1 THEN text || ' my EMAIL' WHEN 2 THEN NULL ELSE text END"


@query("keyword_filter", f"""SELECT doc_id, text, 'safe' AS label FROM (SELECT doc_id, {_KEYED} AS text FROM documents)
WHERE regexp_matches(lower(text), 'email|phone|number|contact|address')""")
def keyworded(t):
    return keyword_filter(t.documents.select("doc_id", F.expr(_KEYED).alias("text")))


@query("drop_incomplete", "SELECT doc_id, toxic AS label FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND toxic IS NOT NULL")
def complete(t):
    joined = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", F.col("toxic").alias("label")), "doc_id", "left")
    return drop_incomplete(joined, "text", "label").select("doc_id", "label")


_SPANS = """CASE o_orderkey % 4 WHEN 0 THEN array(named_struct('start', '3', 'end', CAST(o_orderkey % 50 AS STRING), 'label', 'NAME'), named_struct('start', 'x', 'end', '9', 'label', 'ID'))
 WHEN 1 THEN array() WHEN 2 THEN array(named_struct('start', '1', 'end', '2', 'label', '')) END"""


@query("normalize_spans", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '3-' || CAST(o_orderkey % 50 AS VARCHAR) || '-NAME'
  WHEN 2 THEN '1-2-PII' WHEN 1 THEN '0-4-CITY' ELSE CASE WHEN o_orderkey % 8 = 3 THEN '0-4-CITY' ELSE '' END END AS spans FROM orders""")
def spans(t):
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"), F.expr(_SPANS).alias("privacy_mask"),
        F.expr("""IF(o_orderkey % 8 <> 7, array(named_struct('start', '0', 'end', '4', 'label', 'CITY'),
          named_struct('start', CAST(NULL AS STRING), 'end', '5', 'label', 'CITY')), NULL)""").alias("spans"))
    norm = rows.select("id", normalize_spans(F.col("privacy_mask"), F.col("spans")).alias("s"))
    return norm.select("id", F.array_join(F.transform("s", lambda x: F.concat_ws("-", x["start"], x["end"], x["label"])), ";").alias("spans"))


@query("label_encode", f"WITH {LABELLED_SQL} SELECT doc_id, label, dense_rank() OVER (ORDER BY label) - 1 AS y FROM labelled")
def encoded(t):
    return label_encode(t.labelled().select("doc_id", "label"))


@query("align_schema", """SELECT c_custkey AS id, c_name AS name, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'user' END AS role,
  'local' AS provider, 0 AS is_verified, CAST(NULL AS VARCHAR) AS last_login_at FROM customer""")
def aligned(t):
    users = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                              F.expr("IF(c_mktsegment = 'MACHINERY', 'admin', 'user')").alias("role"))
    return align_schema(users)


@query("normalize_email_key", """SELECT email, min(id) AS id, arg_min(name, id) AS name FROM (
  SELECT 'user' || CAST(c_custkey % 500 AS VARCHAR) || '@ex.com' AS email, c_custkey AS id, c_name AS name FROM customer) GROUP BY 1""")
def emails(t):
    raw = F.expr("CASE c_custkey % 2 WHEN 0 THEN '  User' || CAST(c_custkey % 500 AS STRING) || '@Ex.COM ' ELSE 'user' || CAST(c_custkey % 500 AS STRING) || '@ex.com\\t' END")
    return unique_emails(t.customer.select(F.col("c_custkey").alias("id"), raw.alias("email"), F.col("c_name").alias("name")))


_DAY = "substr(CAST(o_orderdate AS STRING), 1, 10)"
_TIMES = f"""CASE o_orderkey % 9 WHEN 0 THEN {_DAY} || 'T10:20:30Z' WHEN 1 THEN {_DAY} || 'T10:20:30.25+02:00' WHEN 2 THEN {_DAY} || ' 23:59'
 WHEN 3 THEN {_DAY} WHEN 4 THEN 'yesterday' WHEN 5 THEN '' WHEN 6 THEN {_DAY} || 'T07:08:09.123456' WHEN 7 THEN '2024-13-01' END"""

@query("parse_timestamp_lenient", f"""SELECT o_orderkey AS id, strftime(CASE o_orderkey % 9 WHEN 0 THEN o_orderdate + to_seconds(37230) WHEN 1 THEN o_orderdate + to_microseconds(30030250000)
  WHEN 2 THEN o_orderdate + to_minutes(1439) WHEN 3 THEN o_orderdate WHEN 6 THEN o_orderdate + to_microseconds(25689123456)
  WHEN 8 THEN make_timestamp(o_orderkey * 1000000 + 500000) END, '%Y-%m-%d %H:%M:%S.%f') AS parsed FROM orders""")
def lenient(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.expr(_TIMES).alias("text"),
                           F.expr("IF(o_orderkey % 9 = 8, o_orderkey + 0.5D, NULL)").alias("seconds"))
    parsed = F.coalesce(parse_time(F.col("text")), parse_epoch(F.col("seconds")))
    return rows.select("id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"))


_EVENTS = """o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 5 = 1 THEN 0 ELSE o_custkey END AS user_id,
 'chat_message' AS policy_id, 'mask' AS action,
 CASE o_orderkey % 5 WHEN 0 THEN '["US SSN","IPv4 Address"]' WHEN 1 THEN '[]' WHEN 2 THEN 'not json' WHEN 3 THEN NULL ELSE '["Email Address"]' END AS findings,
 CASE WHEN o_orderkey % 3 > 0 THEN '10.0.0.' || CAST(o_orderkey % 256 AS STRING) WHEN o_orderkey % 2 = 0 THEN '' END AS ip_address,
 CASE WHEN o_orderkey % 4 > 0 THEN 'agent' END AS user_agent,
 CASE o_orderkey % 7 WHEN 0 THEN '"quoted text"' WHEN 1 THEN 'plain [REDACTED]' WHEN 2 THEN '"say ' || chr(92) || '"hi' || chr(92) || '" ' || chr(92) || 'u00e9"'
  WHEN 3 THEN '125' WHEN 4 THEN '[1]' WHEN 5 THEN '1, 2' ELSE '' END AS raw_content,
 CAST(o_orderdate AS STRING) AS created_at"""


@query("policy_event_view", f"""SELECT id AS event_id, CASE WHEN user_id IS NULL OR user_id = 0 THEN 'Guest' ELSE CAST(user_id AS VARCHAR) END AS user_id,
  policy_id, action, CASE WHEN findings IS NULL OR findings = '[]' THEN '' WHEN findings = 'not json' THEN 'n' ELSE json_extract_string(findings, '$[0]') END AS findings,
  CASE WHEN coalesce(ip_address, '') = '' THEN 'Unknown' ELSE ip_address END AS ip, coalesce(user_agent, 'Unknown') AS user_agent,
  CASE o_orderkey % 7 WHEN 0 THEN 'quoted text' WHEN 2 THEN 'say "hi" é' ELSE raw_content END AS user_input, substr(created_at, 1, 19) AS created_at
FROM (SELECT o_orderkey, {_EVENTS} FROM orders)""")
def event_view(t):
    view = policy_event_view(t.spark.sql(f"SELECT {_EVENTS} FROM {{o}}", o=t.orders))
    return view.withColumn("created_at", F.date_format(parse_time(F.col("created_at")), "yyyy-MM-dd HH:mm:ss"))


@query("client_ip_from_headers", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN '10.1.0.' || CAST(user_id % 256 AS VARCHAR) WHEN 1 THEN '203.0.113.' || CAST(user_id % 256 AS VARCHAR)
  WHEN 2 THEN '192.0.2.60' WHEN 3 THEN '2001:db8::1' WHEN 4 THEN '198.51.100.7' ELSE 'unknown' END AS ip,
  CASE WHEN event_id % 6 = 5 THEN 'unknown' ELSE event_type END AS agent FROM events""")
def headers(t):
    h = F.expr("""CASE event_id % 6 WHEN 0 THEN map('X-Forwarded-For', '10.1.0.' || CAST(user_id % 256 AS STRING) || ', 10.9.9.9', 'User-Agent', event_type)
      WHEN 1 THEN map('x-forwarded-for', '', 'CF-CONNECTING-IP', '203.0.113.300', 'CF-Connecting-IP', '203.0.113.' || CAST(user_id % 256 AS STRING), 'X-Real-IP', '1.1.1.1', 'x-real-ip', '1.1.1.2', 'USER-AGENT', event_type)
      WHEN 2 THEN map('Forwarded', 'proto=https; For=192.0.2.60;by=10.0.0.1', 'user-agent', event_type)
      WHEN 3 THEN map('forwarded', 'for="[2001:db8::1]"', 'user-agent', event_type)
      WHEN 4 THEN map('Remote-Address', '198.51.100.7', 'user-agent', event_type)
      ELSE map('accept', '*/*') END""")
    rows = t.events.select("event_id", h.alias("headers"))
    return rows.select("event_id", client_ip(F.col("headers")).alias("ip"), client_agent(F.col("headers")).alias("agent"))


@query("display_fields", """SELECT o_orderkey AS id, replace(substr(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000000'), 1, 19), 'T', ' ') AS shown_time,
  CASE WHEN o_orderstatus = 'F' THEN 'Assistant' ELSE 'User' END AS shown_role,
  CASE o_orderkey % 3 WHEN 0 THEN 'Ann' WHEN 1 THEN 'a@ex.com' ELSE 'User' END AS shown_name FROM orders""")
def shown(t):
    cols = display_fields(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.expr("IF(o_orderstatus = 'F', 'assistant', 'USER')"),
        F.expr("IF(o_orderkey % 3 = 0, 'Ann', '')"), F.expr("IF(o_orderkey % 3 = 1, 'a@ex.com', NULL)"))
    return t.orders.select(F.col("o_orderkey").alias("id"), *[c.alias(n) for n, c in cols.items()])


@query("sample_preview", f"""WITH {LABELLED_SQL} SELECT label, left(arg_min(text, {hash_sql(42, 'doc_id')}), 300) AS preview FROM labelled GROUP BY label""")
def preview(t):
    return sample_preview(t.labelled(), "label", "text", hash_order(42, F.col("doc_id")))

"""Readers and writers, each run for real against the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.detection import long_findings
from ..functions.textnorm import escape_newlines
from ..operators.metrics import confusion, report_rows
from ..plans.analyze import analyze, policy_events
from ..session import fresh_dir
from ..sources.chat_log import log_line, read_chat_log
from ..sources.jsonl import override_label, parse_lines, read_jsonl, union_sources, write_jsonl, write_lines
from ..sources.lines import first_numbered, numbered_lines
from ..sources.policy import load_policy, policy_table
from ..sources.appends import append_once, read_appended
from ..sources.sinks import audit_event_rows, chat_message_rows, client_agent, client_ip, policy_event_log, write_metrics
from ..sources.tables import ranged
from .base import CORPUS_SQL, SCORED_SQL, TEXTS_SQL, query, quote
from .finding_sql import ACTION_SQL, findings_sql, flags_sql, merged_sql
from .decisions import ENTITIES, ENTITIES_SQL, POLICY, entity_mask_sql

# A JSON line per document with its whole text; every seventh is cut short.
_OBJECT = "to_json(struct(doc_id AS id, text, 'safe' AS label))"
_LINE = f"CASE WHEN doc_id % 7 = 0 THEN left({_OBJECT}, length({_OBJECT}) DIV 2) ELSE {_OBJECT} END"
_JSON = "id BIGINT, text STRING, label STRING"


def _lines(t):
    return t.documents.select("doc_id", "source", F.expr(_LINE).alias("line"))


@query("read_jsonl_tolerant", "SELECT doc_id AS id, text, 'safe' AS label FROM documents WHERE doc_id % 7 <> 0")
def tolerant(t):
    path = fresh_dir(t.spark, "lines")
    write_lines(_lines(t), F.col("line"), path)
    return read_jsonl(t.spark, path, _JSON)


@query("jsonl_label_override", "SELECT doc_id, text, 'unsafe' AS label FROM documents WHERE doc_id % 7 <> 0")
def override(t):
    parsed = parse_lines(_lines(t).select("doc_id", "line"), F.col("line"), "text STRING, label STRING")
    return override_label(parsed, "unsafe").drop("line")


@query("read_first_n_lines", """SELECT source, line_no, doc_id, text FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS line_no FROM documents) WHERE line_no < 20 AND doc_id % 7 <> 0""")
def first_n(t):
    """The first lines of each source's files, broken ones counted, from files really written."""
    path = fresh_dir(t.spark, "sources")
    lines = ranged(_lines(t), "source", "doc_id")
    lines.select("source", F.col("line").alias("value")).write.partitionBy("source").text(path)
    first = first_numbered(numbered_lines(t.spark, path, by="folder"), 20)
    named = first.select(F.url_decode(F.regexp_extract("file", "/source=([^/]*)/", 1)).alias("source"), "line_no", "value")
    return parse_lines(named, F.col("value"), "id BIGINT, text STRING").select("source", "line_no", F.col("id").alias("doc_id"), "text")


@query("union_sources", """SELECT 'documents' AS source, doc_id AS id, text, lang, NULL AS url FROM documents
UNION ALL SELECT 'benchmark', item_id, text, NULL, NULL FROM benchmark
UNION ALL SELECT 'pages', page_id, html, NULL, url FROM pages""")
def union(t):
    return union_sources({
        "documents": t.documents.select(F.col("doc_id").alias("id"), "text", "lang"),
        "missing": None,
        "benchmark": t.benchmark.select(F.col("item_id").alias("id"), "text"),
        "pages": t.pages.select(F.col("page_id").alias("id"), F.col("html").alias("text"), "url"),
    })


@query("merge_shards", "SELECT doc_id AS id, text FROM documents WHERE doc_id % 7 <> 0 AND lang IN ('en', 'fr')")
def shards(t):
    root = fresh_dir(t.spark, "shards")
    for lang, name in [("en", "balanced_en_v2.jsonl"), ("fr", "balanced_fr_v2.jsonl"), ("de", "other_de.jsonl")]:
        write_lines(_lines(t).join(t.documents.filter(F.col("lang") == lang).select("doc_id"), "doc_id"),
                    F.col("line"), f"{root}/{name}")
    return read_jsonl(t.spark, f"{root}/balanced_*_v2.jsonl", "id BIGINT, text STRING")


@query("write_jsonl", "SELECT doc_id AS id, text, lang FROM documents")
def jsonl_out(t):
    path = fresh_dir(t.spark, "jsonl")
    write_jsonl(t.documents.select(F.col("doc_id").alias("id"), "text", "lang"), path)
    return read_jsonl(t.spark, path, "id BIGINT, text STRING, lang STRING")


@query("escape_newlines_export", "SELECT replace(coalesce(CASE WHEN doc_id % 11 > 0 THEN text END, ''), chr(10), '\\n') AS line FROM documents")
def export(t):
    path = fresh_dir(t.spark, "export")
    texts = t.documents.select(F.when(F.col("doc_id") % 11 > 0, F.col("text")).alias("text"))
    write_lines(texts, escape_newlines(F.col("text")), path)
    return t.spark.read.text(path).withColumnRenamed("value", "line")


_POLICY_VALUES = ", ".join(
    [f"('block', {quote(n)}, 'block')" for n in sorted(POLICY.block)]
    + [f"('mask', {quote(n)}, 'mask')" for n in sorted(POLICY.mask)]
    + [f"('entity', {quote(n)}, {quote(a)})" for n, a in POLICY.entity]
    + [f"('threshold', {quote(n)}, '{v:.2f}')" for n, v in POLICY.thresholds])


def policy_yaml(p=POLICY) -> str:
    lines = ["block_categories:"] + [f'  - "{n}"' for n in sorted(p.block)]
    lines += ["mask_categories:"] + [f'  - "{n}"' for n in sorted(p.mask)]
    lines += ["pii_entity_policy:"] + [f"  {n}: {a}" for n, a in p.entity]
    lines += ["thresholds:"] + [f"  {n}: {v}" for n, v in p.thresholds]
    return "\n".join(lines)


@query("load_policy", f"""WITH {CORPUS_SQL}, {findings_sql('corpus')}, policy(kind, name, value) AS (VALUES {_POLICY_VALUES})
SELECT p.kind, p.name, p.value, count(f.id) AS findings FROM policy p LEFT JOIN found f USING (name) GROUP BY ALL""")
def policy_rows(t):
    """The policy file as rows, with the number of findings each name decides on."""
    path = fresh_dir(t.spark, "policy")
    t.spark.createDataFrame([(policy_yaml(),)], "value string").coalesce(1).write.option("lineSep", "\n").text(path)
    rows = policy_table(t.spark, load_policy(t.spark, path))
    counts = long_findings(t.corpus(), "id").groupBy("name").agg(F.count(F.lit(1)).alias("findings"))
    return rows.join(counts, "name", "left").fillna(0, ["findings"]).select("kind", "name", "value", "findings")


# A day per conversation; every third conversation is a guest's.
_AT = "TIMESTAMP '2024-03-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE"
_AT_SQL = "TIMESTAMP '2024-03-01 00:00:00' + to_hours(conv_id) + to_minutes(turn)"
_ISO_SQL = "strftime({0}, '%Y-%m-%dT%H:%M:%S')"


def _schema(df) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _iso(col):
    return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")


@query("append_chat_message", f"""SELECT CASE WHEN conv_id % 3 > 0 THEN conv_id END AS user_id, role, text AS content,
  {_ISO_SQL.format(_AT_SQL)} AS created_at, strftime({_AT_SQL}, '%Y-%m-%d') AS day FROM conversations""")
def chat_messages(t):
    path = fresh_dir(t.spark, "chat_messages")
    user = F.when(F.col("conv_id") % 3 > 0, F.col("conv_id"))
    rows = chat_message_rows(t.conversations, user, F.col("role"), F.col("text"), F.expr(_AT))
    append_once(rows.filter(F.col("role") == "user"), path, "users")
    append_once(rows.filter(F.col("role") != "user"), path, "others")
    append_once(rows.filter(F.col("role") != "user"), path, "others")  # a repeated job
    written = read_appended(t.spark, path, "user_id BIGINT, role STRING, content STRING, created_at TIMESTAMP, day DATE")
    return written.withColumns({"created_at": _iso(F.col("created_at")), "day": F.col("day").cast("string")})


@query("append_policy_event", f"""WITH RECURSIVE {TEXTS_SQL}, {findings_sql('texts')}, {merged_sql('texts')}, {flags_sql('texts', POLICY)},
named AS (SELECT id, list(name ORDER BY ordinal) AS names FROM found GROUP BY id),
tokens AS (SELECT id, {ENTITIES_SQL} AS entities FROM texts), {entity_mask_sql('tokens')}
SELECT CASE WHEN id % 4 > 0 THEN id END AS user_id, CASE {ACTION_SQL} WHEN 'mask' THEN 'chat_message_masked'
  WHEN 'block' THEN 'chat_message_blocked' ELSE 'chat_message' END AS policy_id, {ACTION_SQL} AS action,
  CAST(to_json(list_concat(coalesce(names, []), list_sort(list_distinct(entities)))) AS VARCHAR) AS findings, '10.0.0.' || CAST(id % 256 AS VARCHAR) AS ip_address, 'unknown' AS user_agent,
  CASE {ACTION_SQL} WHEN 'block' THEN '[BLOCKED BY POLICY]' WHEN 'mask' THEN coalesce(nullif(veiled.out, ''), '[MASKED]') ELSE text END AS raw_content,
  strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(id), '%Y-%m-%dT%H:%M:%S') AS created_at
FROM texts JOIN flags USING (id) JOIN veiled USING (id) LEFT JOIN named USING (id)""")
def policy_log(t):
    """Events with regex findings and entities; both are masked in what is stored."""
    path = fresh_dir(t.spark, "policy_events")
    done = policy_events(analyze(t.texts().withColumn("entities", F.expr(ENTITIES)), entities=F.col("entities")))
    headers = F.create_map(F.lit("X-Real-IP"), F.concat(F.lit("10.0.0."), (F.col("id") % 256).cast("string")))
    at = F.expr("TIMESTAMP '2024-01-01 00:00:00' + id * INTERVAL '1' MINUTE")
    rows = policy_event_log(done, F.when(F.col("id") % 4 > 0, F.col("id")), F.col("policy_id"), F.col("action"),
                            F.col("all_findings"), client_ip(headers), client_agent(headers), F.col("safe_text"), at)
    append_once(rows, path, "documents")
    return read_appended(t.spark, path, f"{_schema(rows)}, day DATE").drop("day").withColumn("created_at", _iso(F.col("created_at")))


_LOG_ACTION = "CASE turn % 3 WHEN 0 THEN 'allow' WHEN 1 THEN 'mask' ELSE 'block' END"
_LOG_USER = "CASE WHEN conv_id % 3 > 0 THEN CAST(conv_id AS STRING) END"


@query("write_chat_log", f"""SELECT conv_id, turn, {_ISO_SQL.format(_AT_SQL)} || ' | user=' || coalesce({_LOG_USER}, 'guest')
  || ' | ' || {_LOG_ACTION} || ' | ' || text AS line FROM conversations""")
def chat_log_lines(t):
    return t.conversations.select("conv_id", "turn", log_line(
        _iso(F.expr(_AT)), F.expr(_LOG_USER), F.expr(_LOG_ACTION), F.col("text")).alias("line"))


@query("parse_chat_log", f"""SELECT 2 * (row_number() OVER (ORDER BY conv_id, turn) - 1) AS record_no, {_ISO_SQL.format(_AT_SQL)} AS ts, {_LOG_USER} AS "user",
  {_LOG_ACTION} AS action, text || ' | more' AS text FROM conversations
UNION ALL SELECT 2 * row_number() OVER (ORDER BY conv_id, turn) - 1, '2025-01-01T00:00:00+00:00', NULL, 'block', 'second' || chr(10) || 'line ' || conv_id FROM conversations""")
def chat_log_records(t):
    """A log of all conversations, written as files and read back; texts hold newlines and the field separator."""
    path = fresh_dir(t.spark, "chat_log")
    first = log_line(_iso(F.expr(_AT)), F.expr(_LOG_USER), F.expr(_LOG_ACTION), F.concat("text", F.lit(" | more")))
    second = F.concat(F.lit("\n2025-01-01T00:00:00+00:00 | user=guest | block | second\nline "), F.col("conv_id").cast("string"))
    rows = t.conversations.select("conv_id", "turn", F.concat(first, second).alias("value"))
    ranged(rows, "conv_id", "turn").select("value").write.text(path)
    return read_chat_log(t.spark, path, by="folder").drop("file")


@query("append_audit_event", """SELECT user_id, event_type, CASE WHEN event_id % 5 = 0 THEN '{}' ELSE '{"k":' || (props->>'k') || ',"value":"' || event_type || '"}' END AS event_data,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at FROM events""")
def audit_events(t):
    path = fresh_dir(t.spark, "audit_logs")
    data = F.when(F.col("event_id") % 5 != 0, F.struct(
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("value")))
    rows = audit_event_rows(t.events, F.col("user_id"), F.col("event_type"), data, F.col("ts").cast("timestamp"))
    append_once(rows, path, "events")
    return read_appended(t.spark, path, f"{_schema(rows)}, day DATE").drop("day").withColumn("created_at", _iso(F.col("created_at")))


@query("scan_table", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan(t):
    return t.customer


@query("write_metrics", f"""WITH {SCORED_SQL}, c AS (SELECT sum(CASE WHEN y = 1 AND p >= 0.5 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y = 0 AND p >= 0.5 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN y = 1 AND p < 0.5 THEN 1 ELSE 0 END) AS fn,
  sum(CASE WHEN y = 0 AND p < 0.5 THEN 1 ELSE 0 END) AS tn FROM scored)
SELECT 'accuracy' AS metric, round((tp + tn) / (tp + tn + fp + fn), 6) AS value FROM c
UNION ALL SELECT 'f1_weighted', round(((tp + fn) * 2.0 * tp / (2.0 * tp + fp + fn) + (tn + fp) * 2.0 * tn / (2.0 * tn + fp + fn)) / (tp + tn + fp + fn), 6) FROM c""")
def metrics_out(t):
    path = fresh_dir(t.spark, "metrics")
    pairs = t.scored().select("y", F.expr("IF(p >= 0.5, 1, 0)").alias("predicted"))
    rows = report_rows(confusion(pairs, "y", "predicted"))
    summary = rows.filter(F.col("label") == "accuracy").select(F.lit("accuracy").alias("metric"), F.col("f1").alias("value")).unionByName(
        rows.filter(F.col("label") == "weighted avg").select(F.lit("f1_weighted").alias("metric"), F.col("f1").alias("value")))
    write_metrics(summary.withColumn("value", F.round("value", 6)), path)
    return t.spark.read.schema("metric STRING, value DOUBLE").json(path)

"""Masking: strategies, overlaps, entities, e-mail clean-up, stored and context texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.detection import long_findings, with_findings
from ..functions.masking import (mask, mask_entities, normalize_masked_email, partial_replacement,
                                 safe_store_text)
from ..functions.patterns import builtin_specs
from ..operators.chat import build_context, sanitize_history
from ..plans.analyze import analyze
from ..sources.policy import Policy
from .base import CORPUS_SQL, ORDER_TEXTS_SQL, query
from .decisions import ENTITIES, ENTITIES_SQL, entity_mask_sql
from .finding_sql import (ACTION_SQL, PARTIAL_TOKEN_SQL, REDACT_TOKEN_SQL, findings_sql, flags_sql, fold_sql,
                          merged_sql)


def _stale_sql(token: str) -> str:
    return f"""WITH RECURSIVE {CORPUS_SQL}, {findings_sql('corpus')},
spans AS (SELECT id, "start", "end", ordinal, {token} AS token FROM found),
{fold_sql('corpus', 'spans', 'masked')} SELECT id, out AS masked FROM masked"""


@query("mask_redact", _stale_sql(REDACT_TOKEN_SQL))
def mask_redact(t):
    found = with_findings(t.corpus(), "text", "f")
    return found.select("id", mask(F.col("text"), F.col("f"), "redact", "reference").alias("masked"))


@query("mask_partial", _stale_sql(PARTIAL_TOKEN_SQL))
def mask_partial(t):
    found = with_findings(t.corpus(), "text", "f")
    return found.select("id", mask(F.col("text"), F.col("f"), "partial", "reference").alias("masked"))


@query("mask_merged_spans", f"""WITH RECURSIVE {CORPUS_SQL}, {findings_sql('corpus')}, {merged_sql('corpus')}
SELECT id, out AS masked FROM masked""")
def mask_merged_spans(t):
    found = with_findings(t.corpus(), "text", "f")
    return found.select("id", mask(F.col("text"), F.col("f"), "partial", "merge").alias("masked"))


def _tokens(key: str, *slugs: str) -> None:
    specs = builtin_specs(*slugs)
    sql = f"""WITH {CORPUS_SQL}, {findings_sql('corpus', specs)}
SELECT id, "start", match, {PARTIAL_TOKEN_SQL} AS token FROM found"""

    @query(key, sql)
    def _(t):
        return long_findings(t.corpus(), "id", specs=specs).select(
            "id", "start", "match", partial_replacement(F.col("name"), F.col("match")).alias("token"))


_tokens("partial_email", "email")
_tokens("partial_phone", "us_phone", "intl_phone")
_tokens("partial_card", "credit_card")
_tokens("partial_default", "ssn", "ipv4", "dob", "db_url", "rsa_token")

# Each document's own entities: its first six words of six or more ASCII letters between spaces.
_OWN = ENTITIES.replace(", 1, 2)", ", 1, 6)")
_OWN_SQL = ENTITIES_SQL.replace("[1:2]", "[1:6]")


@query("mask_entities", f"""WITH masked AS (SELECT doc_id AS id, text AS out FROM documents), tokens AS (SELECT doc_id AS id, {_OWN_SQL} AS entities FROM documents),
{entity_mask_sql('tokens', 6)} SELECT id, len(list_distinct(entities)) AS n, out AS masked FROM veiled""")
def entities(t):
    """Whole documents, each with the entities found in itself."""
    rows = t.texts().withColumn("entities", F.expr(_OWN))
    return rows.select("id", F.size(F.array_distinct("entities")).cast("long").alias("n"), mask_entities(F.col("text"), F.col("entities")).alias("masked"))


_HALF_MASKED = """CASE id % 3 WHEN 0 THEN text || ' [REDACTED_EMAIL]@gmail.[REDACTED_PII] or [redacted_x] @ web . [REDACTED_TLD]'
 WHEN 1 THEN text || ' Write to A.b+c@Mail.Example.ORG, please' ELSE text END"""


@query("normalize_masked_email", f"""WITH {ORDER_TEXTS_SQL} SELECT id, regexp_replace(regexp_replace({_HALF_MASKED},
  '\\[REDACTED_[A-Z]+\\]\\s*@\\s*[a-z0-9-]+\\s*\\.\\s*\\[REDACTED_[A-Z]+\\]', '[EMAIL_REDACTED]', 'gi'),
  '\\b[a-z0-9._%+-]+@(?:[a-z0-9-]+\\.)+[a-z]{{2,}}\\b', '[EMAIL_REDACTED]', 'gi') AS cleaned FROM order_texts""")
def normalized(t):
    texts = t.order_texts().select("id", F.expr(_HALF_MASKED).alias("text"))
    return texts.select("id", normalize_masked_email(F.col("text")).alias("cleaned"))


_STORE_SQL = f"""CASE {ACTION_SQL} WHEN 'block' THEN '[BLOCKED BY POLICY]'
  WHEN 'mask' THEN coalesce(nullif(out, ''), '[MASKED]') ELSE text END"""


@query("safe_store_text", f"""WITH RECURSIVE {CORPUS_SQL}, {findings_sql('corpus')}, {merged_sql('corpus')},
{flags_sql('corpus', Policy())}
SELECT id, {ACTION_SQL} AS action, {_STORE_SQL} AS stored FROM corpus JOIN masked USING (id) JOIN flags USING (id)""")
def stored(t):
    done = analyze(t.corpus())
    return done.select("id", "action", safe_store_text(F.col("action"), F.col("text"), F.col("masked_output")).alias("stored"))


# Conversations with some personal data and secrets added; 3 turns stand for the usual 20,
# since the given conversations are short.
_TURN_TEXT = """CASE WHEN (conv_id + turn) % 4 = 1 THEN text || ' mail u' || CAST(conv_id AS STRING) || '@ex.com or (215) 555-1234'
 WHEN (conv_id + turn) % 7 = 0 THEN text || ' key AKIA' || upper(substr(md5(CAST(conv_id AS STRING)), 1, 16)) ELSE text END"""
_TURNS = 3
_HISTORY_SQL = f"""turns AS (SELECT conv_id, turn, role, {_TURN_TEXT} AS text,
   CAST(conv_id AS VARCHAR) || '.' || CAST(turn AS VARCHAR) AS id FROM conversations),
recent AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= {_TURNS}),
{findings_sql('recent')}, {merged_sql('recent')}, {flags_sql('recent', Policy())},
history AS (SELECT conv_id, turn, role, CASE {ACTION_SQL} WHEN 'block' THEN '[BLOCKED FOR POLICY REASONS]'
  WHEN 'mask' THEN regexp_replace(coalesce(nullif(out, ''), text), '\\b[a-z0-9._%+-]+@(?:[a-z0-9-]+\\.)+[a-z]{{2,}}\\b', '[EMAIL_REDACTED]', 'gi')
  ELSE text END AS content FROM recent JOIN masked USING (id) JOIN flags USING (id))"""


def _history(t):
    return t.conversations.select("conv_id", "turn", "role", F.expr(_TURN_TEXT).alias("text"))


@query("sanitize_history", f"WITH RECURSIVE {_HISTORY_SQL} SELECT * FROM history WHERE role <> 'assistant'")
def history(t):
    return sanitize_history(_history(t), "conv_id", "turn", _TURNS, drop_assistant=True)


@query("build_llm_context", f"""WITH RECURSIVE {_HISTORY_SQL}
SELECT conv_id, turn, role, regexp_replace(content, '\\b[a-z0-9._%+-]+@(?:[a-z0-9-]+\\.)+[a-z]{{2,}}\\b', '[EMAIL_REDACTED]', 'gi') AS content FROM history
UNION ALL SELECT DISTINCT conv_id, -1, 'system', 'You may see placeholders like [EMAIL_REDACTED] or [REDACTED_PII]. Those indicate sensitive data that was removed. Proceed normally using the remaining context to answer the user''s request.' FROM conversations""")
def context(t):
    return build_context(_history(t), "conv_id", "turn", _TURNS)

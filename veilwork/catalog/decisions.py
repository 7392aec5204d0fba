"""Policy decisions and the unified analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.decisions import (confidence, decide, decide_by_severity, flag_block, flag_email, flag_entity,
                                   flag_mask, flag_secret, flag_unsafe)
from ..functions.detection import with_findings
from ..operators.ranking import hash_order, hash_unit
from ..plans.analyze import analyze, attach_scores, policy_events, with_scan_status
from ..sources.policy import Policy
from .base import CORPUS_SQL, TEXTS_SQL, query, unit_sql
from .finding_sql import ACTION_SQL, findings_sql, flags_sql, merged_sql

POLICY = Policy()
_FLAGS = f"WITH {CORPUS_SQL}, {findings_sql('corpus')}, {flags_sql('corpus', POLICY)}"


def _found(t):
    return with_findings(t.corpus(), "text", "f")


@query("decide_action_severity", f"""{_FLAGS} SELECT id, CASE WHEN worst >= 3 THEN 'block' WHEN worst >= 1 THEN 'mask' ELSE 'allow' END AS action FROM flags""")
def by_severity(t):
    return _found(t).select("id", decide_by_severity(F.col("f")).alias("action"))


@query("flag_block_regex", f"{_FLAGS} SELECT id, blocks AS flag FROM flags")
def block_flag(t):
    return _found(t).select("id", flag_block(F.col("f"), POLICY).alias("flag"))


@query("flag_mask_regex", f"{_FLAGS} SELECT id, masks AS flag FROM flags")
def mask_flag(t):
    return _found(t).select("id", flag_mask(F.col("f"), POLICY).alias("flag"))


# Entity labels that a labelling model would give, chosen per document by its id.
_LABELS = "array('B-NAME', 'I-EMAIL', 'b-phone', 'IDCARDNUM', 'O', 'B-DOB', 'CITY', 'Email')"
_LABEL_CASE = "CASE {0} " + " ".join(
    f"WHEN {i} THEN '{label}'" for i, label in enumerate(["B-NAME", "I-EMAIL", "b-phone", "IDCARDNUM", "O", "B-DOB", "CITY", "Email"])) + " END"


def _two_labels(key: str) -> str:
    return f"[{_LABEL_CASE.format(f'{key} % 8')}, {_LABEL_CASE.format(f'({key} // 8) % 8')}]"


def _with_labels(df, key: str = "id"):
    k = F.col(key)
    pick = F.expr(_LABELS)
    return df.withColumn("labels", F.array(F.get(pick, (k % 8).cast("int")), F.get(pick, (F.floor(k / 8) % 8).cast("int"))))


_ENTITY_FLAGS = """list_bool_or(list_transform(labels, lambda x: upper(x) LIKE '%ID%')) AS entity_blocks,
  list_bool_or(list_transform(labels, lambda x: upper(x) LIKE '%NAME%' OR upper(x) LIKE '%EMAIL%' OR upper(x) LIKE '%PHONE%'
    OR upper(x) LIKE '%ADDRESS%' OR upper(x) LIKE '%DOB%' OR upper(x) LIKE '%ORGANIZATION%')) AS entity_masks,
  list_bool_or(list_transform(labels, lambda x: upper(x) LIKE '%EMAIL')) AS entity_email"""


@query("flag_entity_policy", f"""SELECT id, entity_masks AS masks, entity_blocks AS blocks FROM (
  SELECT id, {_ENTITY_FLAGS} FROM (SELECT doc_id AS id, {_two_labels('doc_id')} AS labels FROM documents))""")
def entity_flag(t):
    labelled = _with_labels(t.documents.select(F.col("doc_id").alias("id")))
    return labelled.select("id", flag_entity(F.col("labels"), POLICY, "mask").alias("masks"),
                           flag_entity(F.col("labels"), POLICY, "block").alias("blocks"))


def _doc_flags(labels: str) -> str:
    return f"""{TEXTS_SQL}, {findings_sql('texts')}, {flags_sql('texts', POLICY)},
entity AS (SELECT id, labels, {_ENTITY_FLAGS} FROM (SELECT doc_id AS id, {labels} AS labels FROM documents)),
scores AS (SELECT doc_id AS id, {unit_sql('secret', 'doc_id')} AS secret_score, {unit_sql('unsafe', 'doc_id')} AS unsafe_score
  FROM documents WHERE doc_id % 5 < 3),
full_flags AS (SELECT *, coalesce(secret_score, 0) AS ss, coalesce(unsafe_score, 0) AS us
  FROM flags JOIN entity USING (id) LEFT JOIN scores USING (id))"""


_DOC_FLAGS = _doc_flags(_two_labels("doc_id"))
_DOC_ACTION = """CASE WHEN email OR entity_email THEN 'mask' WHEN blocks OR ss >= 0.70 OR us >= 0.80 OR entity_blocks THEN 'block'
  WHEN masks OR entity_masks THEN 'mask' ELSE 'allow' END"""


def _scores(t):
    """Stand-in for the scores of two models, for three of five documents."""
    ids = t.documents.select(F.col("doc_id").alias("id")).filter(F.col("id") % 5 < 3)
    return ids.select("id", hash_unit(hash_order("secret", F.col("id"))).alias("secret_score"),
                      hash_unit(hash_order("unsafe", F.col("id"))).alias("unsafe_score"))


@query("flag_email_override", f"WITH {_DOC_FLAGS} SELECT id, email OR entity_email AS flag FROM full_flags")
def email_flag(t):
    found = _with_labels(with_findings(t.texts(), "text", "f"))
    return found.select("id", flag_email(F.col("f"), F.col("labels")).alias("flag"))


def _scored_labelled(t):
    return _with_labels(attach_scores(t.texts(), _scores(t), "id", "secret_score", "unsafe_score"))


@query("decide_policy", f"WITH {_DOC_FLAGS} SELECT id, {_DOC_ACTION} AS action FROM full_flags")
def policy(t):
    found = with_findings(_scored_labelled(t), "text", "f")
    return found.select("id", decide(F.col("f"), F.col("secret_score"), F.col("unsafe_score"), F.col("labels")).alias("action"))


@query("flag_secret_score", f"""SELECT doc_id AS id, s >= 0.70 AS flag, round(s, 3) AS confidence FROM (
  SELECT doc_id, coalesce(CASE WHEN doc_id % 5 < 3 THEN {unit_sql('secret', 'doc_id')} END, 0) AS s FROM documents)""")
def secret_flag(t):
    docs = t.documents.select(F.col("doc_id").alias("id"))
    scored = attach_scores(docs, _scores(t), "id", "secret_score")
    return scored.select("id", flag_secret(F.col("secret_score"), POLICY).alias("flag"),
                         confidence(F.col("secret_score")).alias("confidence"))


@query("flag_ml_score", f"""SELECT doc_id AS id, CASE WHEN s >= 0.80 THEN 'unsafe' ELSE 'safe' END AS label,
  round(s, 3) AS confidence, CASE WHEN doc_id % 5 < 3 THEN 'ensemble' ELSE 'none' END AS model FROM (
  SELECT doc_id, coalesce(CASE WHEN doc_id % 5 < 3 THEN {unit_sql('unsafe', 'doc_id')} END, 0) AS s FROM documents)""")
def ml_flag(t):
    docs = t.documents.select(F.col("doc_id").alias("id"))
    scored = docs.join(_scores(t).select("id", "unsafe_score"), "id", "left")
    return scored.select(
        "id", F.when(flag_unsafe(F.col("unsafe_score"), POLICY), "unsafe").otherwise("safe").alias("label"),
        confidence(F.col("unsafe_score")).alias("confidence"),
        F.when(F.col("unsafe_score").isNotNull(), "ensemble").otherwise("none").alias("model"))


@query("attach_scores", f"""SELECT doc_id AS id, round(coalesce(CASE WHEN doc_id % 5 < 3 THEN {unit_sql('secret', 'doc_id')} END, 0), 6) AS secret_score,
  round(coalesce(CASE WHEN doc_id % 5 < 3 THEN {unit_sql('unsafe', 'doc_id')} END, 0), 6) AS unsafe_score FROM documents""")
def scores(t):
    docs = t.documents.select(F.col("doc_id").alias("id"))
    joined = attach_scores(docs, _scores(t), "id", "secret_score", "unsafe_score")
    return joined.select("id", F.round("secret_score", 6).alias("secret_score"), F.round("unsafe_score", 6).alias("unsafe_score"))


# Entities that a labelling model would give: the first two words of six or more ASCII letters
# that stand between spaces, each with one of the document's two labels.
ENTITIES = "slice(filter(split(text, ' ', -1), x -> x RLIKE '^[A-Za-z]{6,}$'), 1, 2)"
ENTITIES_SQL = "list_filter(string_split(text, ' '), lambda x: regexp_full_match(x, '[A-Za-z]{6,}'))[1:2]"


def entity_mask_sql(flags: str, most: int = 2) -> str:
    """CTE `veiled`(id, entities, out): at most so many entities masked as whole words in any case, longest first."""
    edge = "[^\\p{L}\\p{M}\\p{N}_]"
    step = lambda text, n: f"""CASE WHEN len(e) >= {n} THEN regexp_replace({text}, '(?i)(^|{edge})(' || e[{n}] || ')($|{edge})', '\\1[REDACTED_PII]\\3', 'g') ELSE {text} END"""
    # Twice each: neighbours share the character between them.
    steps = ",\n".join(f"veiled{k + 1} AS (SELECT id, entities, e, {step('out', k // 2 + 1)} AS out FROM {'ordered' if k == 0 else f'veiled{k}'})" for k in range(2 * most))
    return f"""ordered AS (SELECT id, out, entities, list_transform(list_sort(list_transform(list_distinct(entities), lambda x: {{'n': -length(x), 't': x}})), lambda s: s.t) AS e
  FROM masked JOIN {flags} USING (id)),
{steps}, veiled AS (SELECT id, entities, out FROM veiled{2 * most})"""


@query("analyze", f"""WITH RECURSIVE {_doc_flags(f"({_two_labels('doc_id')})[1:len({ENTITIES_SQL})]")}, {merged_sql('texts')},
named AS (SELECT id, string_agg(name, '; ' ORDER BY ordinal) AS names FROM found GROUP BY id),
tokens AS (SELECT doc_id AS id, {ENTITIES_SQL} AS entities FROM documents), {entity_mask_sql('tokens')}
SELECT id, {_DOC_ACTION} AS action, CASE WHEN {_DOC_ACTION} = 'mask' THEN veiled.out END AS masked_output,
  {_DOC_ACTION} = 'mask' AND veiled.out = texts.text AS unmasked,
  coalesce(names, '') AS regex_findings, array_to_string(list_sort(list_distinct(entities)), '; ') AS pii_entities,
  round(ss, 3) AS secret_confidence, round(us, 3) AS ml_confidence,
  'regex; bert_secret_clf_v2; pii_ner_v3; ' || CASE WHEN unsafe_score IS NULL THEN 'none' ELSE 'ensemble' END AS sources
FROM full_flags JOIN veiled USING (id) JOIN texts USING (id) LEFT JOIN named USING (id)""")
def full_analysis(t):
    """Findings, entities, decision, masked text and confidences of every document."""
    texts = _with_labels(t.texts().join(_scores(t), "id", "left")).withColumn("entities", F.expr(ENTITIES))
    labels = F.expr("slice(labels, 1, size(entities))")
    done = analyze(texts, "text", F.col("secret_score"), F.col("unsafe_score"), entities=F.col("entities"), labels=labels)
    unmasked = F.coalesce(F.col("masked_output") == F.col("text"), F.lit(False))
    return done.select("id", "action", "masked_output", unmasked.alias("unmasked"), F.array_join("regex_findings", "; ").alias("regex_findings"),
                       F.array_join("pii_entities", "; ").alias("pii_entities"), "secret_confidence", "ml_confidence",
                       F.array_join("sources", "; ").alias("sources"))


@query("policy_event_rows", f"""WITH RECURSIVE {CORPUS_SQL}, {findings_sql('corpus')}, {merged_sql('corpus')}, {flags_sql('corpus', POLICY)},
named AS (SELECT id, string_agg(name, '; ' ORDER BY ordinal) AS names FROM found GROUP BY id),
tokens AS (SELECT id, {ENTITIES_SQL} AS entities FROM corpus), {entity_mask_sql('tokens')}
SELECT id, {ACTION_SQL} AS action, CASE {ACTION_SQL} WHEN 'mask' THEN 'chat_message_masked' WHEN 'block' THEN 'chat_message_blocked'
  ELSE 'chat_message' END AS policy_id,
  concat_ws('; ', names, nullif(array_to_string(list_sort(list_distinct(entities)), '; '), '')) AS findings,
  CASE {ACTION_SQL} WHEN 'block' THEN '[BLOCKED BY POLICY]' WHEN 'mask' THEN coalesce(nullif(veiled.out, ''), '[MASKED]') ELSE text END AS safe_text
FROM corpus JOIN flags USING (id) JOIN veiled USING (id) LEFT JOIN named USING (id)""")
def event_rows(t):
    corpus = t.corpus().withColumn("entities", F.expr(ENTITIES))
    return policy_events(analyze(corpus, entities=F.col("entities"))).select(
        "id", "action", "policy_id", F.array_join("all_findings", "; ").alias("findings"), "safe_text")


@query("fail_open_default", f"""{_FLAGS} SELECT id, CASE WHEN length(id) = 4 THEN 'failed' ELSE 'ok' END AS scan_status,
  CASE WHEN length(id) = 4 THEN 'block' ELSE {ACTION_SQL} END AS action FROM flags""")
def fail_default(t):
    """An analysis that gave no result (here: of the ids of four characters) blocks by default."""
    decided = with_findings(t.corpus(), "text", "f").select("id", decide(F.col("f")).alias("action"))
    partial = decided.withColumn("action", F.when(F.length("id") != 4, F.col("action")))
    return with_scan_status(partial).select("id", "scan_status", "action")

"""Sampling, balancing and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cleaning import keyword_filter
from ..operators.sampling import (ALPHABET, CODE_TEXTS, CONFIG_TEXTS, LOG_TEXTS, SENTENCE_TEXTS, UNSAFE_TEXTS,
                                  balance_with_synthetic, generate_non_secrets, length_bins, oversample, sample_n,
                                  stratified_split, three_way_split)
from .base import LABELLED_SQL, hash_sql, query, quote, unit_sql
from .cleaning import _KEYED


@query("sample_n", f"SELECT doc_id, text FROM documents ORDER BY {hash_sql(42, 'doc_id')}, doc_id LIMIT 500")
def sampled(t):
    return sample_n(t.documents.select("doc_id", "text"), "doc_id", 500)


@query("length_quantile_bin", """WITH q AS (SELECT quantile_cont(length(text), [0.25, 0.5, 0.75]) AS e FROM documents)
SELECT doc_id, CAST(length(text) > e[1] AS INT) + CAST(length(text) > e[2] AS INT) + CAST(length(text) > e[3] AS INT) AS len_bin FROM documents, q""")
def binned(t):
    return length_bins(t.documents.select("doc_id", "text"), "text").select("doc_id", "len_bin")


@query("oversample_minority", f"""WITH {LABELLED_SQL}, sizes AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS most FROM labelled GROUP BY label),
ranked AS (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {hash_sql(42, 'doc_id')}, doc_id) AS r FROM labelled)
SELECT doc_id, label, unnest(generate_series(0, most // n - 1 + CASE WHEN r <= most % n THEN 1 ELSE 0 END)) AS "copy" FROM ranked JOIN sizes USING (label)""")
def oversampled(t):
    return oversample(t.labelled().select("doc_id", "label"), "label", "doc_id")


@query("stratified_split", f"""WITH {LABELLED_SQL}
SELECT doc_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {hash_sql(42, 'doc_id')}, doc_id) <= count(*) OVER (PARTITION BY label) * 4 // 5
  THEN 'train' ELSE 'test' END AS split FROM labelled""")
def stratified(t):
    return stratified_split(t.labelled().select("doc_id", "label"), "label", "doc_id")


@query("three_way_split", f"""SELECT doc_id, CASE WHEN {unit_sql(42, 'doc_id')} < 0.8 THEN 'train' WHEN {unit_sql(42, 'doc_id')} < 0.9 THEN 'val' ELSE 'test' END AS split FROM documents""")
def three_way(t):
    return three_way_split(t.documents.select("doc_id"), "doc_id")


def _pick_sql(texts, seed):
    return f"[{', '.join(quote(x) for x in texts)}][CAST(('0x' || substr({hash_sql(seed, 'id')}, 1, 8))::BIGINT % {len(texts)} AS INT) + 1]"


@query("balance_with_synthetic", f"""WITH safe AS (SELECT doc_id AS id, text FROM (SELECT doc_id, {_KEYED} AS text FROM documents)
  WHERE regexp_matches(lower(text), 'email|phone|number|contact|address'))
SELECT id, text, 'safe' AS label FROM safe UNION ALL SELECT id, {_pick_sql(UNSAFE_TEXTS, 'unsafe42')}, 'unsafe' FROM safe""")
def balanced(t):
    safe = keyword_filter(t.documents.select(F.col("doc_id").alias("id"), F.expr(_KEYED).alias("text")))
    return balance_with_synthetic(safe, "id")


@query("generate_non_secrets", f"""WITH u AS (SELECT o_orderkey AS id, {unit_sql('kind42', 'o_orderkey')} AS u, sha256({hash_sql('letters42', 'o_orderkey')}) AS d,
  8 + ('0x' || substr({hash_sql('length42', 'o_orderkey')}, 1, 8))::BIGINT % 13 AS n FROM orders)
SELECT id, CASE WHEN u < 0.4 THEN 'gibberish' WHEN u < 0.7 THEN 'code' WHEN u < 0.85 THEN 'config' WHEN u < 0.95 THEN 'log' ELSE 'sentence' END AS kind,
  CASE WHEN u < 0.4 THEN left(array_to_string(list_transform(generate_series(0, 19), lambda i: substr('{ALPHABET}', CAST(('0x' || substr(d, CAST(i * 3 + 1 AS INT), 3))::INT % 36 AS INT) + 1, 1)), ''), CAST(n AS INT))
   WHEN u < 0.7 THEN {_pick_sql(CODE_TEXTS, 'pick42')} WHEN u < 0.85 THEN {_pick_sql(CONFIG_TEXTS, 'pick42')} WHEN u < 0.95 THEN {_pick_sql(LOG_TEXTS, 'pick42')}
   ELSE {_pick_sql(SENTENCE_TEXTS, 'pick42')} END AS text, 0 AS label FROM u""")
def non_secrets(t):
    return generate_non_secrets(t.orders.select(F.col("o_orderkey").alias("id")), "id")

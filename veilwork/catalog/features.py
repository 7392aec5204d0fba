"""Text features, TF-IDF and scaling."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.text_features import (FEATURES_5, FEATURES_13, entropy, pii_flags, secret_features, with_features_5,
                                       with_features_13)
from ..operators.features import MAX_FEATURES, align_width, assemble, counted_terms, fit_scale, scale, tfidf_fit, tfidf_transform
from ..session import materialize
from .base import CORPUS_SQL, STOP_WORDS, query, quote

_ENTROPY_CTE = """letters AS (SELECT id, unnest(string_split({text}, '')) AS c FROM {source} WHERE length({text}) > 0),
bits AS (SELECT id, -sum(n * 1.0 / total * log2(n * 1.0 / total)) AS entropy FROM (
  SELECT id, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY id) AS total FROM letters GROUP BY id, c) GROUP BY id)"""


@query("shannon_entropy", f"""WITH {CORPUS_SQL}, {_ENTROPY_CTE.format(text='text', source='corpus')}
SELECT id, round(coalesce(entropy, 0) + 0.0, 6) AS entropy FROM corpus LEFT JOIN bits USING (id)""")
def shannon(t):
    return t.corpus().select("id", F.round(entropy(F.col("text")), 6).alias("entropy"))


@query("secret_features", f"""WITH {CORPUS_SQL}, {_ENTROPY_CTE.format(text='text', source='corpus')}
SELECT id, length(text) AS length, round(coalesce(entropy, 0), 6) AS entropy,
  CAST(regexp_matches(text, 'eyJ[a-zA-Z0-9_-]{{10,}}\\.') AS INT) AS looks_jwt, CAST(regexp_matches(text, '(sk_|gh[pousr]_)') AS INT) AS looks_key
FROM corpus LEFT JOIN bits USING (id)""")
def secret(t):
    cols = secret_features(F.col("text"))
    cols["entropy"] = F.round(cols["entropy"], 6)
    return t.corpus().select("id", *[c.alias(n) for n, c in cols.items()])


_FLAGS_SQL = """CAST(regexp_matches(t, 'eyJ[a-zA-Z0-9_-]{10,}\\.') AS INT) AS looks_jwt, CAST(regexp_matches(t, '(sk_|gh[pousr]_)') AS INT) AS looks_key,
  CAST(regexp_matches(t, '\\b\\d{3}-\\d{2}-\\d{4}\\b') AS INT) AS looks_ssn, CAST(regexp_matches(t, '\\b(?:\\d[ -]*?){13,16}\\b') AS INT) AS looks_cc,
  CAST(regexp_matches(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') AS INT) AS looks_email,
  CAST(regexp_matches(t, '\\(?\\d{3}\\)?[-.\\s]?\\d{3}[-.\\s]?\\d{4}') AS INT) AS looks_phone"""
_CLEAN_CTE = f"""{CORPUS_SQL},
clean AS (SELECT id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS t FROM corpus),
{_ENTROPY_CTE.format(text='t', source='clean')},
base AS (SELECT id, t, length(t) AS chars, len(regexp_extract_all(t, '\\S+')) AS words, coalesce(entropy, 0) AS entropy,
  length(regexp_replace(t, '[^0-9]', '', 'g')) AS digits, length(regexp_replace(t, '[A-Za-z0-9\\s]', '', 'g')) AS symbols, {_FLAGS_SQL}
  FROM clean LEFT JOIN bits USING (id))"""


@query("pii_flags", f"""WITH {CORPUS_SQL} SELECT id, {_FLAGS_SQL} FROM (SELECT id, text AS t FROM corpus)""")
def flags(t):
    return t.corpus().select("id", *[c.alias(n) for n, c in pii_flags(F.col("text")).items()])


@query("text_features_5", f"""WITH {_CLEAN_CTE} SELECT id, round(chars / 500.0::DOUBLE * 10, 6) AS chars, round(words / 100.0::DOUBLE * 10, 6) AS words,
  round(entropy * 10, 6) AS entropy, round(digits::DOUBLE / greatest(chars, 1) * 10, 6) AS digit_ratio,
  round(symbols::DOUBLE / greatest(chars, 1) * 10, 6) AS symbol_ratio FROM base""")
def five(t):
    return with_features_5(t.corpus()).select("id", *[F.round(c, 6).alias(c) for c in FEATURES_5])


_THIRTEEN_SQL = """chars / 500.0::DOUBLE * 10 AS chars, words / 100.0::DOUBLE * 10 AS words, chars::DOUBLE / greatest(words, 1) AS avg_word_length,
  words::DOUBLE / greatest(chars, 1) * 10 AS word_density, entropy * 10 AS entropy, digits::DOUBLE / greatest(chars, 1) * 10 AS digit_ratio,
  symbols::DOUBLE / greatest(chars, 1) * 10 AS symbol_ratio, looks_jwt * 50.0::DOUBLE AS looks_jwt, looks_key * 50.0::DOUBLE AS looks_key,
  looks_ssn * 50.0::DOUBLE AS looks_ssn, looks_cc * 50.0::DOUBLE AS looks_cc, looks_email * 50.0::DOUBLE AS looks_email, looks_phone * 50.0::DOUBLE AS looks_phone"""


def _rounded(columns=FEATURES_13):
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


@query("text_features_13", f"WITH {_CLEAN_CTE}, f AS (SELECT id, {_THIRTEEN_SQL} FROM base) SELECT id, {_rounded()} FROM f")
def thirteen(t):
    return with_features_13(t.corpus()).select("id", *[F.round(c, 6).alias(c) for c in FEATURES_13])


@query("scale_unit_variance", f"""WITH {_CLEAN_CTE}, f AS (SELECT id, {_THIRTEEN_SQL} FROM base),
s AS (SELECT {', '.join(f'CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS s_{c}' for c in FEATURES_13)} FROM f)
SELECT id, {', '.join(f'round({c} / s_{c}, 5) AS {c}' for c in FEATURES_13)} FROM f, s""")
def scaled(t):
    table = with_features_13(t.corpus()).drop("text")
    done = scale(table, fit_scale(table, FEATURES_13))
    return done.select("id", *[F.round(c, 5).alias(c) for c in FEATURES_13])


_STOP = ", ".join(quote(w) for w in STOP_WORDS)
_FEATURES = MAX_FEATURES
_TERMS_SQL = f"""words AS (SELECT doc_id, list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS w FROM documents),
terms AS (SELECT doc_id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + count(*))) + 1.0 AS idf
  FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY cf DESC, term LIMIT {_FEATURES}),
weighted AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN vocab USING (term)),
tfidf AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS tfidf FROM weighted)"""


@query("tfidf_fit", f"WITH {_TERMS_SQL} SELECT term, df, cf, round(idf, 6) AS idf FROM vocab")
def fit(t):
    return tfidf_fit(t.texts(), "id", "text", _FEATURES, stop_words=STOP_WORDS).withColumn("idf", F.round("idf", 6))


@query("tfidf_transform", f"""WITH {_TERMS_SQL} SELECT doc_id AS id, term, round(tfidf, 5) AS tfidf FROM tfidf""")
def transform(t):
    counted = materialize(counted_terms(t.texts(), "id", "text", STOP_WORDS), "counted")
    vocabulary = tfidf_fit(counted, "id", "text", _FEATURES)
    return tfidf_transform(counted, "id", "text", vocabulary).withColumn("tfidf", F.round("tfidf", 5))


@query("assemble_features", f"""WITH {_CLEAN_CTE}, f AS (SELECT id, {_THIRTEEN_SQL} FROM base)
SELECT id, 13 AS width, round({' + '.join(FEATURES_13)}, 4) AS total FROM f""")
def assembled(t):
    """Vector width and sum, which a vector column can be compared by."""
    table = with_features_13(t.corpus()).drop("text")
    vectors = assemble(table, FEATURES_13).select("id", vector_to_array("features").alias("v"))
    return vectors.select("id", F.size("v").alias("width"),
                          F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("align_feature_width", "SELECT vec_id, 8 AS width, round(CAST(list_sum(embedding[1:8]) AS DOUBLE), 3) AS total FROM embeddings")
def aligned(t):
    narrow = align_width(F.col("embedding").cast("array<double>"), 8, pad=True)
    return t.embeddings.select("vec_id", narrow.alias("v")).select(
        "vec_id", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 3).alias("total"))

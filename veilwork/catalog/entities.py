"""Entity annotations: tokens, labels, chunks and their scores.

Gold spans are the findings of the derived texts; predictions are the same spans with a
hash-chosen part dropped or relabelled.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.detection import long_findings, with_findings
from ..functions.entities import (IGNORED_TOKENS, TAGGER_LABELS, bio_to_entities, decode_labels, distinct_entities,
                                  filter_token_labels, spans_to_bio, tokens)
from ..operators.entities import entity_averages, entity_scores, label_counts, label_set, schema_form, top_by_f1
from ..operators.ranking import hash_order
from ..operators.subwords import learn_vocabulary, subword_tokens
from ..session import materialize
from .base import ORDER_TEXTS_SQL, query, quote
from .finding_sql import findings_sql

_TOKEN_SQL = "'[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]'"


def _tokens_sql(source: str) -> str:
    """CTE tokens(id, k, token, start, end)."""
    return f"""raw_tokens AS (SELECT id, regexp_extract_all(text, {_TOKEN_SQL}) AS ts, string_split_regex(text, {_TOKEN_SQL}) AS gs FROM {source}),
split_tokens AS (SELECT id, unnest(ts) AS token, unnest(gs[1:len(ts)]) AS gap, unnest(generate_series(1, len(ts))) AS k FROM raw_tokens WHERE len(ts) > 0),
tokens AS (SELECT id, k - 1 AS k, token, CAST(sum(length(gap) + length(token)) OVER w - length(token) AS INT) AS "start", CAST(sum(length(gap) + length(token)) OVER w AS INT) AS "end"
  FROM split_tokens WINDOW w AS (PARTITION BY id ORDER BY k))"""


@query("tokens_with_offsets", f"""WITH texts AS (SELECT doc_id AS id, text FROM documents), {_tokens_sql('texts')}
SELECT t.id, count(k) AS n, CAST(coalesce(sum("start"), 0) AS BIGINT) AS starts, CAST(coalesce(sum("end"), 0) AS BIGINT) AS ends, md5(coalesce(string_agg(token, ' ' ORDER BY k), '')) AS tokens
FROM texts t LEFT JOIN tokens USING (id) GROUP BY t.id""")
def offsets(t):
    """Every token of every document, summed up per document to be comparable."""
    rows = t.texts().select("id", tokens(F.col("text")).alias("t"))
    return rows.select("id", F.size("t").alias("n"),
                       F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x["start"]).alias("starts"),
                       F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x["end"]).alias("ends"),
                       F.md5(F.array_join(F.transform("t", lambda x: x["token"]), " ")).alias("tokens"))


# The vocabulary of the registered subword queries; SQL learns the same one and walks by its longest matches.
_SIZE, _LONGEST = 4000, 8
_SUBWORDS = f"""texts AS (SELECT doc_id AS id, text FROM documents), {_tokens_sql('texts')},
words AS (SELECT token AS word, count(*) AS n FROM tokens GROUP BY 1),
starts AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS s FROM words),
cuts AS (SELECT word, n, s, unnest(range(1, least({_LONGEST}, length(word) - s + 1) + 1)) AS l FROM starts),
cut AS (SELECT word, n, s, l, CASE WHEN s > 1 THEN '##' ELSE '' END || substr(word, s, l) AS piece FROM cuts),
pieces AS (SELECT piece, l, sum(n) AS n FROM cut GROUP BY piece, l),
vocabulary AS (SELECT piece FROM pieces WHERE l = 1 UNION ALL (SELECT piece FROM pieces WHERE l > 1 ORDER BY n * (l - 1) DESC, piece LIMIT {_SIZE})),
longest AS (SELECT word, s, max(l) AS l FROM cut JOIN vocabulary USING (piece) GROUP BY word, s),
walk AS (SELECT word, 1::BIGINT AS s, 0 AS j FROM words UNION ALL SELECT word, walk.s + l, j + 1 FROM walk JOIN longest USING (word, s)),
parts AS (SELECT word, s, j, l, CASE WHEN s > 1 THEN '##' ELSE '' END || substr(word, s, l) AS piece FROM walk JOIN longest USING (word, s)),
subtokens AS (SELECT id, k, j, piece AS token, t."start" + s - 1 AS "start", t."start" + s - 1 + l AS "end" FROM tokens t JOIN parts ON word = token)"""


def _subwords(t):
    """(id, text, t): whole documents with their subword tokens. The vocabulary has a bounded number of pieces."""
    texts = t.texts()
    pieces = sorted(r["piece"] for r in learn_vocabulary(texts, "text", _SIZE, _LONGEST).select("piece").collect())
    return texts.withColumn("t", subword_tokens(F.col("text"), pieces))


@query("subword_tokens", f"""WITH RECURSIVE {_SUBWORDS} SELECT x.id, count(j) AS n, CAST(coalesce(sum("start"), 0) AS BIGINT) AS starts,
  CAST(coalesce(sum("end"), 0) AS BIGINT) AS ends, md5(coalesce(string_agg(token, ' ' ORDER BY k, j), '')) AS tokens
FROM texts x LEFT JOIN subtokens USING (id) GROUP BY x.id""")
def subwords(t):
    """Every subword token of every document, summed up per document to be comparable."""
    return _subwords(t).select("id", F.size("t").cast("long").alias("n"),
                               F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x["start"]).alias("starts"),
                               F.aggregate("t", F.lit(0).cast("bigint"), lambda a, x: a + x["end"]).alias("ends"),
                               F.md5(F.array_join(F.transform("t", lambda x: x["token"]), " ")).alias("tokens"))


@query("subword_labels", f"""WITH RECURSIVE {_SUBWORDS}, {findings_sql('texts')},
cover AS (SELECT s.id, s.k, s.j, s.token, count(*) AS n, arg_max(f.name, f.ordinal) AS name FROM subtokens s
  JOIN found f ON f.id = s.id AND s."start" >= f."start" AND s."end" <= f."end" GROUP BY ALL),
bare AS (SELECT id, replace(token, '##', '') AS token, CASE WHEN n = 1 THEN 'B-' ELSE 'I-' END || name AS label FROM cover)
SELECT id, token, label FROM bare WHERE lower(token) NOT IN ({', '.join(quote(x) for x in IGNORED_TOKENS)}) AND length(token) >= 2
  AND length(regexp_replace(token, '[^0-9]', '', 'g')) * 2 <= length(token) AND regexp_matches(token, '[^\\W_]')""")
def subword_labels(t):
    """The documents' findings as labels of subword tokens, without what a tagger is not trusted on."""
    found = with_findings(_subwords(t), "text", "f")
    spans = F.transform("f", lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["name"].alias("label")))
    labelled = found.filter(F.size("f") > 0).select("id", spans_to_bio(F.col("t"), spans).alias("b"))
    pairs = F.transform("b", lambda b: F.struct(b["token"].alias("token"), b["label"].alias("label")))
    return labelled.select("id", F.explode(filter_token_labels(pairs)).alias("x")).select("id", "x.token", "x.label")


def _gold(t):
    """(id, text, spans) with the findings as annotated spans, overlaps included."""
    return with_findings(t.order_texts(), "text", "f").select("id", "text", F.transform("f", lambda f: F.struct(
        f["start"].alias("start"), f["end"].alias("end"), f["name"].alias("label"))).alias("spans"))


def _bio():
    return spans_to_bio(tokens(F.col("text")), F.col("spans"))


_FOUND = f"{ORDER_TEXTS_SQL}, {findings_sql('order_texts')}, {_tokens_sql('order_texts')}"
_BIO = f"""{_FOUND}, cover AS (SELECT t.id, t.k, count(*) AS n, arg_max(f.name, f.ordinal) AS last_name
  FROM tokens t JOIN found f ON f.id = t.id AND t."start" >= f."start" AND t."end" <= f."end" GROUP BY t.id, t.k),
bio AS (SELECT t.id, t.k, token, t."start", t."end", CASE WHEN n IS NULL THEN 'O' WHEN n = 1 THEN 'B-' || last_name ELSE 'I-' || last_name END AS label
  FROM tokens t LEFT JOIN cover USING (id, k))"""


@query("spans_to_bio", f"WITH {_BIO} SELECT id, CAST(k AS INT) AS k, token, label FROM bio")
def bio(t):
    return _gold(t).select("id", F.posexplode(_bio()).alias("k", "x")).select("id", "k", "x.token", "x.label")


_PSEUDO = " ".join(f"WHEN {i} THEN {quote(x)}" for i, x in enumerate(["O", "B-NAME", "I-NAME", "B-ID"]))
_IGNORED = ", ".join(quote(x) for x in IGNORED_TOKENS)
_PAIRS_SQL = f"""{ORDER_TEXTS_SQL}, {_tokens_sql('order_texts')},
pairs AS (SELECT id, k, CASE WHEN k % 5 = 3 THEN '##' ELSE '' END || token AS token, CASE k % 4 {_PSEUDO} END AS label FROM tokens),
kept AS (SELECT id, k, replace(token, '##', '') AS token, label FROM pairs WHERE label <> 'O'
  AND lower(replace(token, '##', '')) NOT IN ({_IGNORED}) AND length(replace(token, '##', '')) >= 2
  AND length(regexp_replace(token, '[^0-9]', '', 'g')) * 2 <= length(replace(token, '##', ''))
  AND regexp_matches(replace(token, '##', ''), '[^\\W_]'))"""


def _pairs(t):
    """(token, label) lists with labels by position and some subword marks."""
    label = F.array(*[F.lit(x) for x in ["O", "B-NAME", "I-NAME", "B-ID"]])
    return t.order_texts().select("id", F.transform(tokens(F.col("text")), lambda x, i: F.struct(
        F.concat(F.when(i % 5 == 3, "##").otherwise(""), x["token"]).alias("token"),
        F.get(label, i % 4).alias("label"))).alias("p"))


@query("filter_token_labels", f"WITH {_PAIRS_SQL} SELECT id, token, label FROM kept")
def kept(t):
    return _pairs(t).select("id", F.explode(filter_token_labels(F.col("p"))).alias("x")).select("id", "x.token", "x.label")


@query("distinct_entities", f"""WITH {_PAIRS_SQL} SELECT o.id, coalesce(e.entities, '') AS entities FROM order_texts o LEFT JOIN (
  SELECT id, string_agg(DISTINCT token, ' ' ORDER BY token) AS entities FROM kept GROUP BY id) e USING (id)""")
def distinct(t):
    return _pairs(t).select("id", F.array_join(distinct_entities(F.col("p")), " ").alias("entities"))


@query("decode_labels", f"""SELECT event_id, coalesce(nullif(CASE WHEN event_id % 11 < 8 THEN [{', '.join(quote(x) for x in TAGGER_LABELS)}][event_id % 11 + 1] ELSE '' END
  || ' ' || CASE WHEN user_id % 11 < 8 THEN [{', '.join(quote(x) for x in TAGGER_LABELS)}][user_id % 11 + 1] ELSE '' END, ' '), '') AS labels FROM events""")
def decoded(t):
    """Two label ids per event; ids from 8 on have no label."""
    ids = F.array(F.col("event_id") % 11, F.col("user_id") % 11)
    one = F.transform(ids, lambda i: F.array_join(decode_labels(F.array(i)), ""))
    return t.events.select("event_id", F.coalesce(F.nullif(F.array_join(one, " "), F.lit(" ")), F.lit("")).alias("labels"))


_CHUNKS = f"""{_BIO}, marked AS (SELECT *, substr(label, 3) AS kind, lag(label) OVER w AS before FROM bio WINDOW w AS (PARTITION BY id ORDER BY k)),
opened AS (SELECT *, sum(CASE WHEN label <> 'O' AND (label LIKE 'B-%' OR before IS NULL OR before = 'O' OR substr(before, 3) <> kind) THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY k) AS chunk FROM marked),
chunks AS (SELECT id, min(kind) AS type, min("start") AS "start", max("end") AS "end" FROM opened WHERE label <> 'O' GROUP BY id, chunk)"""


def _chunks(t):
    return _gold(t).select("id", F.explode(bio_to_entities(_bio())).alias("e")).select("id", "e.type", "e.start", "e.end")


@query("bio_to_entities", f"""WITH {_CHUNKS} SELECT id, type, "start", "end" FROM chunks""")
def entities(t):
    return _chunks(t)


def _gold_spans(t):
    """The findings as spans, written: gold and predictions both read them, and texts are searched once."""
    return materialize(long_findings(t.order_texts(), "id").select("id", F.col("name").alias("type"), "start", "end"), "gold")


def _predicted(gold):
    """A fifth of the spans is missing, a seventh has another type."""
    h = F.conv(F.substring(hash_order("ner", F.col("id"), F.col("start")), 1, 4), 16, 10).cast("int")
    return gold.withColumn("h", h).filter(F.col("h") % 5 != 0).withColumn(
        "type", F.when(F.col("h") % 7 == 0, "Email Address").otherwise(F.col("type"))).drop("h")


_GOLD_SQL = f"""{ORDER_TEXTS_SQL}, {findings_sql('order_texts')}, gold AS (SELECT id, name AS type, "start", "end" FROM found),
hashed AS (SELECT *, ('0x' || substr(md5('ner|' || CAST(id AS VARCHAR) || '|' || CAST("start" AS VARCHAR)), 1, 4))::INT AS h FROM gold),
pred AS (SELECT id, CASE WHEN h % 7 = 0 THEN 'Email Address' ELSE type END AS type, "start", "end" FROM hashed WHERE h % 5 <> 0),
hits AS (SELECT type, count(*) AS hit FROM (SELECT DISTINCT * FROM gold INTERSECT SELECT DISTINCT * FROM pred) GROUP BY type),
counted AS (SELECT coalesce(g.type, p.type) AS type, coalesce(support, 0) AS support, coalesce(named, 0) AS named FROM
  (SELECT type, count(*) AS support FROM (SELECT DISTINCT * FROM gold) GROUP BY type) g FULL JOIN (SELECT type, count(*) AS named FROM (SELECT DISTINCT * FROM pred) GROUP BY type) p ON g.type = p.type),
rates AS (SELECT type, support, named, coalesce(hit, 0) AS hit, CASE WHEN named > 0 THEN coalesce(hit, 0) / named::DOUBLE ELSE 0 END AS p,
  CASE WHEN support > 0 THEN coalesce(hit, 0) / support::DOUBLE ELSE 0 END AS r FROM counted LEFT JOIN hits USING (type)),
scores AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM rates)"""


def _scores(t):
    gold = _gold_spans(t)
    return entity_scores(gold, _predicted(gold), "id")


def _rounded(df, *keep):
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("entity_prf", f"WITH {_GOLD_SQL} SELECT type, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1, support FROM scores")
def prf_rows(t):
    return _rounded(_scores(t), "type")


@query("entity_prf_averages", f"""WITH {_GOLD_SQL}, m AS (SELECT sum(hit) / sum(named)::DOUBLE AS p, sum(hit) / sum(support)::DOUBLE AS r, CAST(sum(support) AS BIGINT) AS n FROM scores)
SELECT 'micro avg' AS average, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, n AS support FROM m
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(sum(support) AS BIGINT) FROM scores
UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), round(sum(f * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM scores""")
def averages(t):
    return _rounded(entity_averages(_scores(t)), "average")


@query("top_entities_by_f1", f"WITH {_GOLD_SQL} SELECT type, round(f, 6) AS f1 FROM scores ORDER BY f DESC, type LIMIT 10")
def best(t):
    return top_by_f1(_scores(t)).select("type", F.round("f1", 6).alias("f1"))


@query("entity_counts_true_vs_pred", f"""WITH {_GOLD_SQL} SELECT type AS label, coalesce(g.n, 0) AS true_count, coalesce(p.n, 0) AS predicted_count FROM
  (SELECT type, count(*) AS n FROM gold GROUP BY type) g FULL JOIN (SELECT type, count(*) AS n FROM pred GROUP BY type) p USING (type)""")
def true_vs_predicted(t):
    gold = _gold_spans(t)
    return label_counts(gold, _predicted(gold), "type")


@query("distinct_labels", f"""WITH {ORDER_TEXTS_SQL}, {findings_sql('order_texts')}, forms AS (
  SELECT DISTINCT p || name AS label FROM found, (VALUES ('B-'), ('I-')) v(p))
SELECT 'O' AS label, 0 AS label_id UNION ALL SELECT label, CAST(row_number() OVER (ORDER BY label) AS INT) FROM forms""")
def labels(t):
    return label_set(long_findings(t.order_texts(), "id"), "name")


@query("schema_detect", """SELECT 'span' AS form, count(*) AS examples FROM orders UNION ALL SELECT 'token', count(*) FROM conversations""")
def forms(t):
    """Annotated texts and token lists, told apart by their columns."""
    spans = _gold(t)
    token_lists = t.conversations.select(F.transform(tokens(F.col("text")), lambda x: x["token"]).alias("tokens"))
    return spans.agg(F.count(F.lit(1)).alias("examples")).select(F.lit(schema_form(spans)).alias("form"), "examples").unionByName(
        token_lists.agg(F.count(F.lit(1)).alias("examples")).select(F.lit(schema_form(token_lists)).alias("form"), "examples"))

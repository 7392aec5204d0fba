"""Dataset and finding summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.decisions import any_finding
from ..functions.detection import long_findings, with_findings
from ..operators.features import explode_terms
from ..operators.summaries import class_balance, class_counts, daily_findings, findings_summary, over_days, top_terms
from ..plans.analyze import analyze
from ..session import materialize
from .base import CORPUS_SQL, LABELLED_SQL, STOP_WORDS, TEXTS_SQL, query
from .decisions import POLICY
from .features import _STOP
from .finding_sql import ACTION_SQL, findings_sql, flags_sql


@query("class_counts", f"WITH {LABELLED_SQL} SELECT label, count(*) AS n FROM labelled GROUP BY label")
def counts(t):
    return class_counts(t.labelled()).orderBy(F.col("n").desc(), "label")


@query("class_balance_pivot", f"""WITH {LABELLED_SQL} SELECT source, count(*) FILTER (label = 'safe') AS safe,
  count(*) FILTER (label = 'unsafe') AS unsafe FROM labelled GROUP BY source""")
def balance(t):
    return class_balance(t.labelled(), "source", "label", ["safe", "unsafe"])


@query("any_flag", f"""WITH {CORPUS_SQL}, {findings_sql('corpus')}
SELECT c.id, coalesce(bool_or(category = 'Secret'), FALSE) AS any_secret, coalesce(bool_or(severity = 'medium'), FALSE) AS any_medium
FROM corpus c LEFT JOIN found f USING (id) GROUP BY c.id""")
def any_flag(t):
    found = with_findings(t.corpus(), "text", "f")
    return found.select("id", any_finding(F.col("f"), lambda f: f["category"] == "Secret").alias("any_secret"),
                        any_finding(F.col("f"), lambda f: f["severity"] == "medium").alias("any_medium"))


@query("count_distinct_matches", f"""WITH {CORPUS_SQL}, {findings_sql('corpus')}
SELECT name, count(DISTINCT trim(match)) AS matches FROM found WHERE category = 'Secret' GROUP BY name""")
def matches(t):
    found = long_findings(t.corpus(), "id").filter(F.col("category") == "Secret")
    return found.groupBy("name", F.trim("match").alias("match")).count().groupBy("name").agg(
        F.count(F.lit(1)).alias("matches"))


@query("findings_summary", f"""WITH {CORPUS_SQL}, {findings_sql('corpus')}
SELECT category, severity, name, count(*) AS findings, count(DISTINCT id) AS texts FROM found GROUP BY ALL""")
def summary(t):
    return findings_summary(t.corpus())


_DAY = "CAST(DATE '2024-01-01' + CAST(id % 7 AS INT) AS STRING)"


@query("daily_findings", f"""WITH {TEXTS_SQL}, {findings_sql('texts')}, {flags_sql('texts', POLICY)}, decided AS (SELECT id, {ACTION_SQL} AS action FROM flags),
keyed AS (SELECT id, unnest([{{'level': 'name', 'value': name}}, {{'level': 'category', 'value': category}}, {{'level': 'severity', 'value': severity}}]) AS k, 1 AS n FROM found
  UNION ALL SELECT id, unnest([{{'level': 'action', 'value': action}}, {{'level': 'all', 'value': ''}}]), coalesce(c, 0)
  FROM decided LEFT JOIN (SELECT id, count(*) AS c FROM found GROUP BY id) USING (id))
SELECT {_DAY} AS day, k.level AS level, k.value AS value, CAST(sum(n) AS BIGINT) AS findings, count(DISTINCT id) AS texts
FROM keyed GROUP BY GROUPING SETS (({_DAY}, k.level, k.value), (k.level, k.value))""")
def by_day(t):
    """Findings and texts by name, category, severity, action and in all, per day and (day null) over all days."""
    analysed = analyze(t.texts()).select(F.expr(_DAY).alias("day"), "action", "findings")
    daily = materialize(daily_findings(analysed, "day", "action"), "daily")
    total = over_days(daily).select(F.lit(None).cast("string").alias("day"), "level", "value", "findings", "texts")
    return daily.select("day", "level", "value", "findings", "texts").unionByName(total)


@query("top_terms_log_odds", f"""WITH {LABELLED_SQL},
words AS (SELECT doc_id, label, list_filter(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS w FROM labelled),
terms AS (SELECT DISTINCT doc_id, label, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM words),
n AS (SELECT count(*) FILTER (label = 'safe') AS ns, count(*) FILTER (label = 'unsafe') AS nu FROM labelled),
odds AS (SELECT term, ln((count(*) FILTER (label = 'unsafe') + 1.0) / (nu + 2.0)) - ln((count(*) FILTER (label = 'safe') + 1.0) / (ns + 2.0)) AS w
  FROM terms, n GROUP BY term, ns, nu HAVING count(*) >= 2)
SELECT term, round(w, 4) AS weight, 'safe' AS label FROM (SELECT * FROM odds ORDER BY round(w, 8), term LIMIT 20)
UNION ALL SELECT term, round(w, 4), 'unsafe' FROM (SELECT * FROM odds ORDER BY round(w, 8) DESC, term LIMIT 20)""")
def log_odds(t):
    """Terms that speak most for a class, by smoothed log odds of occurring in a text."""
    labelled = t.labelled()
    sizes = {r["label"]: r["n"] for r in class_counts(labelled).collect()}
    rows = explode_terms(labelled, "doc_id", "text", STOP_WORDS, keep=["label"])
    per_term = rows.groupBy("term").agg(F.count_if(F.col("label") == "unsafe").alias("u"),
                                        F.count_if(F.col("label") == "safe").alias("s"))
    weight = (F.ln((F.col("u") + 1.0) / (sizes["unsafe"] + 2.0)) - F.ln((F.col("s") + 1.0) / (sizes["safe"] + 2.0)))
    odds = per_term.filter(F.col("u") + F.col("s") >= 2).select("term", F.round(weight, 8).alias("weight"))
    return top_terms(odds, "term", "weight").withColumn("weight", F.round("weight", 4))

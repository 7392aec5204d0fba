"""Pattern detection: each spec alone, all together, validators, order, custom specs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.detection import finding_names, long_findings, severity_rank_col, with_findings
from ..functions.patterns import PatternSpec, builtin_specs
from ..functions.validators import ipv4_ok, luhn_ok, ssn_ok
from .base import CORPUS_SQL, ORDER_TEXTS_SQL, query
from .finding_sql import CHECKS, findings_sql, spec_sql


def _register(spec: PatternSpec) -> None:
    sql = f"""WITH {CORPUS_SQL}, hits AS ({spec_sql(spec, 0, 'corpus')})
SELECT id, name, category, severity, match, "start", "end" FROM hits"""

    @query(f"detect_{spec.slug}", sql)
    def _(t, spec=spec):
        return long_findings(t.corpus(), "id", specs=[spec]).drop("ordinal")


for _spec in builtin_specs():
    _register(_spec)


@query("detect", f"""WITH {CORPUS_SQL}, {findings_sql('corpus')}
SELECT id, name, category, severity, match, "start", "end" FROM found_all""")
def detect(t):
    return long_findings(t.corpus(), "id", dedupe=False).drop("ordinal")


@query("order_and_dedupe", f"""WITH {CORPUS_SQL}, {findings_sql('corpus')}
SELECT id, CAST(ordinal AS INT) AS ordinal, name, severity, "start", "end" FROM found""")
def order_and_dedupe(t):
    return long_findings(t.corpus(), "id").select("id", "ordinal", "name", "severity", "start", "end")


@query("finding_names", f"""WITH {CORPUS_SQL}, {findings_sql('corpus')}
SELECT c.id, coalesce(n.names, '') AS names FROM corpus c LEFT JOIN (
  SELECT id, string_agg(name, '; ' ORDER BY ordinal) AS names FROM found GROUP BY id) n USING (id)""")
def names(t):
    return with_findings(t.corpus(), "text", "f").select("id", F.array_join(finding_names(F.col("f")), "; ").alias("names"))


@query("severity_rank", f"""WITH {CORPUS_SQL}, {findings_sql('corpus')}
SELECT severity, rank AS severity_rank, count(*) AS n FROM found GROUP BY ALL
UNION ALL SELECT event_type, 0, count(*) FROM events GROUP BY 1""")
def severity_ranks(t):
    found = long_findings(t.corpus(), "id").groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    unknown = t.events.groupBy(F.col("event_type").alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(unknown).select("severity", severity_rank_col(F.col("severity")).alias("severity_rank"), "n")


_CARDS = "lpad(CAST(o_orderkey AS STRING), 4, '4') || ' ' || lpad(CAST(o_custkey AS STRING), 5, '2') || '-' || lpad(CAST(o_orderkey * 7 AS STRING), 6, '9')"
_IPS = "CAST(o_orderkey % 400 AS STRING) || '.' || CAST(o_custkey % 300 AS STRING) || '.0.' || CAST(o_orderkey % 7 AS STRING)"
_SSNS = "lpad(CAST(o_custkey % 1000 AS STRING), 3, '0') || '-' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') || '-' || lpad(CAST(o_orderkey % 10000 AS STRING), 4, '0')"


@query("validate_luhn", f"SELECT id, value, {CHECKS['luhn'].format(v='value')} AS ok FROM (SELECT o_orderkey AS id, {_CARDS} AS value FROM orders)")
def validate_luhn(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.expr(_CARDS).alias("value")).withColumn("ok", luhn_ok(F.col("value")))


@query("validate_ipv4", f"SELECT id, value, {CHECKS['ipv4'].format(v='value')} AS ok FROM (SELECT o_orderkey AS id, {_IPS} AS value FROM orders)")
def validate_ipv4(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.expr(_IPS).alias("value")).withColumn("ok", ipv4_ok(F.col("value")))


@query("validate_ssn", f"SELECT id, value, {CHECKS['ssn'].format(v='value')} AS ok FROM (SELECT o_orderkey AS id, {_SSNS} AS value FROM orders)")
def validate_ssn(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.expr(_SSNS).alias("value")).withColumn("ok", ssn_ok(F.col("value")))


CUSTOM = [
    PatternSpec("Order Reference", "Business", "low", r"\border \d+\b"),
    PatternSpec("Card Like", "Business", "high", r"\b\d{4} \d{4} \d{4} \d{4}\b", "luhn"),
    PatternSpec("Hex Digest", "Business", "medium", r"\b[0-9a-f]{32}\b", "no_such_validator"),
]


@query("custom_patterns", f"""WITH {ORDER_TEXTS_SQL}, {findings_sql('order_texts', CUSTOM)}
SELECT id, name, category, severity, match, "start", "end" FROM found""")
def custom_patterns(t):
    return long_findings(t.order_texts(), "id", specs=CUSTOM).drop("ordinal")

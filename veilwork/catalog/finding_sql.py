"""Findings in DuckDB SQL, written from the meaning: extract, split, add up lengths."""

from __future__ import annotations

from ..functions.patterns import PatternSpec, builtin_specs
from .base import quote

LUHN_SQL = """(length(regexp_replace({v}, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND
  list_sum(list_transform(generate_series(1, length(regexp_replace({v}, '[^0-9]', '', 'g'))), lambda i:
    CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(regexp_replace({v}, '[^0-9]', '', 'g')), i, 1) AS INT)
         ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr(reverse(regexp_replace({v}, '[^0-9]', '', 'g')), i, 1) AS INT) + 1]
    END)) % 10 = 0)"""
IPV4_SQL = "(list_max(list_transform(string_split({v}, '.'), lambda p: CAST(p AS INT))) <= 255)"
SSN_SQL = ("(NOT regexp_matches({v}, '^(000|666|9)') AND substr({v}, 5, 2) <> '00' AND substr({v}, 8, 4) <> '0000')")
CHECKS = {"luhn": LUHN_SQL, "ipv4": IPV4_SQL, "ssn": SSN_SQL, None: "TRUE"}


def re2(spec: PatternSpec) -> str:
    """RE2 has no look-around; at the edge of a date a word boundary says the same on these tables."""
    return spec.pattern.replace(r"(?<!\d)", r"\b").replace(r"(?!\d)", r"\b")


def spec_sql(spec: PatternSpec, number: int, source: str) -> str:
    """All valid matches of one spec with offsets, from `source`(id, text)."""
    pattern = quote(re2(spec))
    # A card number may end in a blank before a word; RE2 knows ASCII words only, so accents go.
    text = "replace(strip_accents(text), 'ß', 's')" if spec.slug == "credit_card" else "text"
    rank = {"low": 0, "medium": 1, "high": 2, "critical": 3}.get(spec.severity, 0)
    check = CHECKS.get(spec.validator, "TRUE").format(v="match")
    return f"""SELECT id, {number} AS no, {quote(spec.name)} AS name, {quote(spec.category)} AS category,
  {quote(spec.severity)} AS severity, {rank} AS rank, match, CAST(s AS INT) AS "start", CAST(s + length(match) AS INT) AS "end" FROM (
  SELECT id, ms[k] AS match, list_sum(list_transform(gs[1:k], lambda g: length(g)))
    + coalesce(list_sum(list_transform(ms[1:k-1], lambda m: length(m))), 0) AS s FROM (
    SELECT id, ms, gs, unnest(generate_series(1, len(ms))) AS k FROM (
      SELECT id, regexp_extract_all({text}, {pattern}) AS ms, string_split_regex({text}, {pattern}) AS gs
      FROM {source} WHERE regexp_matches({text}, {pattern})))) WHERE {check}"""


def findings_sql(source: str, specs: list[PatternSpec] | None = None, cte: str = "found") -> str:
    """CTEs `<cte>_all` (every match) and `<cte>` (ordered, identical spans reduced to the first)."""
    parts = "\nUNION ALL ".join(spec_sql(s, i, source) for i, s in enumerate(specs or builtin_specs()))
    return f"""{cte}_all AS ({parts}),
{cte} AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "start", rank DESC, no) - 1 AS ordinal FROM (
  SELECT * FROM {cte}_all QUALIFY row_number() OVER (PARTITION BY id, "start", "end" ORDER BY rank DESC, no) = 1))"""


PARTIAL_TOKEN_SQL = """CASE
  WHEN name = 'Email Address' AND length(match) - length(replace(match, '@', '')) = 1
    THEN '[REDACTED_EMAIL]@' || split_part(match, '@', 2)
  WHEN name = 'US Phone Number' AND length(regexp_replace(match, '[^0-9]', '', 'g')) >= 10
    THEN '***-***-' || right(regexp_replace(match, '[^0-9]', '', 'g'), 4)
  WHEN name = 'Credit Card Number' AND length(regexp_replace(match, '[^0-9]', '', 'g')) >= 12
    THEN '[REDACTED_CC]' || repeat('*', length(regexp_replace(match, '[^0-9]', '', 'g')) - 4)
         || right(regexp_replace(match, '[^0-9]', '', 'g'), 4)
  ELSE '[REDACTED]' END"""
REDACT_TOKEN_SQL = "'[REDACTED:' || name || ']'"


def fold_sql(source: str, spans: str, cte: str, order: str = '"start" DESC, ordinal') -> str:
    """CTE `<cte>`(id, out): spans replaced one after the other in `order`, with original offsets."""
    return f"""{cte}_ord AS (SELECT id, "start", "end", token, row_number() OVER (PARTITION BY id ORDER BY {order}) AS n FROM {spans}),
{cte}_fold AS (SELECT id, 0 AS n, text AS out FROM {source}
  UNION ALL SELECT f.id, f.n + 1, left(f.out, o."start") || o.token || substr(f.out, o."end" + 1)
  FROM {cte}_fold f JOIN {cte}_ord o ON o.id = f.id AND o.n = f.n + 1),
{cte} AS (SELECT id, out FROM {cte}_fold QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1)"""


def merged_sql(source: str, cte: str = "masked") -> str:
    """CTE `<cte>`(id, out): partial masking over unions of overlapping spans. Needs `found`."""
    return f"""{cte}_edge AS (SELECT *, CASE WHEN "start" < max("end") OVER (PARTITION BY id ORDER BY ordinal
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM found),
{cte}_isle AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY ordinal) AS isle FROM {cte}_edge),
{cte}_span AS (SELECT id, min("start") AS "start", max("end") AS "end", isle AS ordinal,
    CASE WHEN count(*) > 1 THEN '[REDACTED]' ELSE max({PARTIAL_TOKEN_SQL}) END AS token
  FROM {cte}_isle GROUP BY id, isle),
{fold_sql(source, f'{cte}_span', cte)}"""


def names_sql(names) -> str:
    return ", ".join(quote(n) for n in sorted(names))


def flags_sql(source: str, policy, cte: str = "flags") -> str:
    """CTE `<cte>`(id, email, blocks, masks, worst) for every text. Needs `found`."""
    return f"""{cte} AS (SELECT s.id, coalesce(bool_or(lower(name) LIKE '%email address%'), FALSE) AS email,
  coalesce(bool_or(name IN ({names_sql(policy.block)}) OR category = 'Secret' OR severity IN ('high', 'critical')), FALSE) AS blocks,
  coalesce(bool_or(name IN ({names_sql(policy.mask)}) OR category = 'PII' OR (category = 'Network' AND severity = 'medium')), FALSE) AS masks,
  coalesce(max(rank), 0) AS worst
  FROM {source} s LEFT JOIN found f USING (id) GROUP BY s.id)"""


ACTION_SQL = "CASE WHEN email THEN 'mask' WHEN blocks THEN 'block' WHEN masks THEN 'mask' ELSE 'allow' END"

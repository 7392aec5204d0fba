"""Findings of a text as an array column: every match of every spec with exact offsets.

A row stays in one task and in one narrow projection. Per spec a cheap anchor test goes
first, then one search; only texts that hold a match pay for extraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .patterns import DIGIT, ODD_FOLDS, SEVERITY_ORDER, PatternSpec, builtin_specs, java_pattern, severity_rank
from .validators import VALIDATORS



HITS = "_hits"
NO_HITS = "CAST(array() AS array<struct<no:int,matches:array<string>,gaps:array<string>>>)"
FINDINGS = "array<struct<name:string,category:string,severity:string,match:string,start:int,end:int>>"


def bind(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.transform(F.array(value), body)[0]


def severity_rank_col(severity: Column) -> Column:
    """low 0, medium 1, high 2, critical 3; anything else 0."""
    rank = F.lit(0)
    for i, name in enumerate(SEVERITY_ORDER):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank


def sql_literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _may_match(text: str, spec: PatternSpec) -> str:
    """Cheap tests that every match implies, cheapest first."""
    tests = []
    if spec.anchor:
        tests.append(" OR ".join(f"contains({text}, {sql_literal(a)})" for a in spec.anchor))
    if spec.keywords:
        words = [f"contains(lower({text}), {sql_literal(k)})" for k in spec.keywords]
        tests.append(" OR ".join(words + [f"contains({text}, {sql_literal(c)})" for c in ODD_FOLDS]))
    if spec.gate and DIGIT in spec.gate:
        tests.insert(0, f"{text} RLIKE {sql_literal(java_pattern(DIGIT))}")
    if spec.gate:
        tests.append(f"{text} RLIKE {sql_literal(java_pattern(spec.gate))}")
    return " AND ".join(f"({t})" for t in tests) or "true"


def _raw_hit(text: str, number: int, spec: PatternSpec) -> str:
    """Array of one (spec number, matches, gaps), or of none. Gaps are the stretches around the matches."""
    pattern = sql_literal(spec.java())
    return (f"CASE WHEN ({_may_match(text, spec)}) AND {text} RLIKE {pattern} THEN array(named_struct("
            f"'no', {number}, 'matches', regexp_extract_all({text}, {pattern}, 0), "
            f"'gaps', split({text}, {pattern}, -1))) ELSE {NO_HITS} END")


CHUNK = 32


def running(values: Column, combine) -> Column:
    """Running result of an associative `combine` over non-negative integers, 0 being its neutral element.

    Chunk by chunk: growing one array element by element would copy it each time.
    """
    def local(chunk: Column) -> Column:
        start = F.struct(F.lit(0).alias("so_far"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, n: Column) -> Column:
            now = combine(acc["so_far"], n)
            return F.struct(now.alias("so_far"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(chunk, start, step)

    def chunked(v: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(v), F.lit(CHUNK))
        blocks = F.transform(firsts, lambda first: local(F.slice(v, first, CHUNK)))

        def joined(b: Column) -> Column:
            ends = local(F.transform(b, lambda x: x["so_far"]))["out"]
            return bind(ends, lambda e: F.flatten(F.transform(b, lambda block, i: bind(
                F.when(i > 0, F.get(e, i - 1)).otherwise(0),
                lambda before: F.transform(block["out"], lambda n: combine(before, n))))))

        return bind(blocks, joined)

    return bind(values, lambda v: F.when(F.size(v) <= CHUNK, local(v)["out"]).otherwise(chunked(v)))


def running_totals(steps: Column) -> Column:
    """Sum of the steps up to and with each one."""
    return running(steps, lambda a, b: a + b)


def place_matches(matches: Column, gaps: Column) -> Column:
    """(match, start, end) in code points: each match ends where the gaps and matches up to it end."""
    def place(both: Column) -> Column:
        steps = F.zip_with(F.slice(both["g"], 1, F.size(both["m"])), both["m"], lambda g, m: F.length(g) + F.length(m))
        return F.zip_with(both["m"], running_totals(steps), lambda m, end: F.struct(
            m.alias("match"), (end - F.length(m)).alias("start"), end.alias("end")))

    return bind(F.struct(matches.alias("m"), gaps.alias("g")), place)


def _placed(hit: Column) -> Column:
    return F.transform(place_matches(hit["matches"], hit["gaps"]), lambda m: F.struct(
        hit["no"].alias("no"), m["match"].alias("match"), m["start"].alias("start"), m["end"].alias("end")))


def _valid(match: Column, number: Column, specs: Sequence[PatternSpec]) -> Column:
    """A spec with an unknown validator name is not validated."""
    ok = F.lit(True)
    for name, check in VALIDATORS.items():
        numbers = [i for i, s in enumerate(specs) if s.validator == name]
        if numbers:
            ok = F.when(number.isin(numbers), check(match)).otherwise(ok)
    return ok


def _pick(number: Column, values: Sequence[str]) -> Column:
    return F.get(F.expr(f"array({', '.join(sql_literal(v) for v in values)})"), number)


def _raw_hits(text: str, specs: Sequence[PatternSpec]) -> Column:
    return F.expr(f"concat({', '.join(_raw_hit(text, i, s) for i, s in enumerate(specs))})")


def _from_hits(hits: Column, specs: Sequence[PatternSpec], dedupe: bool) -> Column:
    ranks = F.expr(f"array({', '.join(str(-severity_rank(s.severity)) for s in specs)})")
    placed = F.flatten(F.transform(hits, _placed))
    checked = F.filter(placed, lambda f: _valid(f["match"], f["no"], specs))

    def by_span(f: Column) -> Column:
        return F.struct(f["start"].alias("start"), f["end"].alias("end"), F.get(ranks, f["no"]).alias("rank"),
                        f["no"].alias("no"), f["match"].alias("match"))

    def by_order(f: Column) -> Column:
        return F.struct(f["start"].alias("start"), f["rank"].alias("rank"), f["no"].alias("no"),
                        f["end"].alias("end"), f["match"].alias("match"))

    spans = F.array_sort(F.transform(checked, by_span))
    if dedupe:
        spans = bind(spans, lambda a: F.filter(a, lambda f, i: (i == 0) | ~(
            (F.get(a, i - 1)["start"] == f["start"]) & (F.get(a, i - 1)["end"] == f["end"]))))
    ordered = F.array_sort(F.transform(spans, by_order))
    return F.transform(ordered, lambda f: F.struct(
        _pick(f["no"], [s.name for s in specs]).alias("name"),
        _pick(f["no"], [s.category for s in specs]).alias("category"),
        _pick(f["no"], [s.severity for s in specs]).alias("severity"),
        f["match"].alias("match"), f["start"].alias("start"), f["end"].alias("end")))


def with_findings(df: DataFrame, text: str = "text", out: str = "findings",
                  specs: Sequence[PatternSpec] | None = None, dedupe: bool = True) -> DataFrame:
    """Adds the findings of a text column, ordered by start, then severity (highest first), then spec.

    With `dedupe`, only the first finding of each identical span stays; findings that merely
    overlap all stay. A null text has no findings.

    Two projections on purpose: the searches run in generated code once per text, and only
    texts with a hit enter the second one's array functions.
    """
    specs = list(specs or builtin_specs())
    hits = F.col(HITS)
    found = F.when(F.size(hits) > 0, _from_hits(hits, specs, dedupe)).otherwise(F.array().cast(FINDINGS))
    return df.withColumn(HITS, _raw_hits(text, specs)).withColumn(out, found).drop(HITS)


def finding_names(found: Column) -> Column:
    return F.transform(found, lambda f: f["name"])


def long_findings(df: DataFrame, id_col: str, text_col: str = "text",
                  specs: Sequence[PatternSpec] | None = None, dedupe: bool = True) -> DataFrame:
    """One row per finding: id, ordinal, name, category, severity, match, start, end.

    The array is exploded as an expression, not as a named column: Spark would derive a
    "not empty" filter from a column and search every text twice.
    """
    specs = list(specs or builtin_specs())
    searched = df.select(id_col, _raw_hits(text_col, specs).alias(HITS))
    found = F.when(F.size(HITS) > 0, _from_hits(F.col(HITS), specs, dedupe))
    return searched.select(id_col, F.posexplode(found).alias("ordinal", "_f")).select(
        id_col, "ordinal", "_f.name", "_f.category", "_f.severity", "_f.match", "_f.start", "_f.end")

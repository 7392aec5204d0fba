"""Replacing findings and entities in a text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .detection import bind, running
from .patterns import BOUNDARY, java_pattern

# ---------------------------------------------------------------------------
# The tokens written into texts, and the patterns of e-mail clean-up.
# ---------------------------------------------------------------------------
REDACTED = "[REDACTED]"
REDACTED_EMAIL = "[REDACTED_EMAIL]"
REDACTED_CARD = "[REDACTED_CC]"
REDACTED_ENTITY = "[REDACTED_PII]"
NORMALIZED_EMAIL = "[EMAIL_REDACTED]"
STORED_BLOCKED = "[BLOCKED BY POLICY]"
STORED_MASKED = "[MASKED]"
CONTEXT_BLOCKED = "[BLOCKED FOR POLICY REASONS]"
BROKEN_EMAIL = r"(?i)\[REDACTED_[A-Z]+\]\s*@\s*[a-z0-9\-]+\s*\.\s*\[REDACTED_[A-Z]+\]"
WHOLE_EMAIL = r"(?i)\b[a-z0-9._%+\-]+@(?:[a-z0-9\-]+\.)+[a-z]{2,}\b"
# ---------------------------------------------------------------------------


def partial_email(value: Column) -> Column:
    """Keeps the domain; null unless there is exactly one @."""
    parts = F.split(value, "@", -1)
    return F.when(F.size(parts) == 2, F.concat(F.lit(REDACTED_EMAIL + "@"), F.get(parts, 1)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^\p{Nd}]", "")


def partial_phone(value: Column) -> Column:
    """Keeps the last four digits; null below ten digits."""
    digits = _digits(value)
    return F.when(F.length(digits) >= 10, F.concat(F.lit("***-***-"), F.right(digits, F.lit(4))))


def partial_card(value: Column) -> Column:
    """Stars for all but the last four digits; null below twelve digits."""
    digits = _digits(value)
    kept = F.concat(F.lit(REDACTED_CARD), F.repeat(F.lit("*"), F.length(digits) - 4), F.right(digits, F.lit(4)))
    return F.when(F.length(digits) >= 12, kept)


def partial_replacement(name: Column, value: Column) -> Column:
    special = (
        F.when(name == "Email Address", partial_email(value))
        .when(name == "US Phone Number", partial_phone(value))
        .when(name == "Credit Card Number", partial_card(value))
    )
    return F.coalesce(special, F.lit(REDACTED))


def redact_replacement(name: Column, value: Column) -> Column:
    return F.concat(F.lit("[REDACTED:"), name, F.lit("]"))


STRATEGIES = {"partial": partial_replacement, "redact": redact_replacement}


def _mask_stale(text: Column, found: Column, replace) -> Column:
    """Right to left with the original offsets, so overlapping spans cut into replacements."""
    ordered = F.array_sort(F.transform(found, lambda f, i: F.struct(
        (-f["start"]).alias("key"), i.alias("i"), f["end"].alias("end"),
        replace(f["name"], f["match"]).alias("token"))))
    return F.aggregate(ordered, text, lambda acc, f: F.concat(
        F.substr(acc, F.lit(1), -f["key"]), f["token"],
        F.substr(acc, f["end"] + 1, F.greatest(F.length(acc), F.lit(0)))))


BLOCK = 64


def _merged_spans(found: Column, replace, merged_token) -> Column:
    """(start, end, token) of each union of overlapping findings, in order.

    A finding opens a union if it starts behind the furthest end so far.
    """
    def unions(f: Column) -> Column:
        furthest = running(F.transform(f, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        return bind(furthest, lambda reach: bind(
            F.filter(F.sequence(F.lit(0), F.size(f) - 1),
                     lambda i: (i == 0) | (F.get(f, i)["start"] >= F.get(reach, i - 1))),
            lambda opens: F.transform(opens, lambda i, k: union(f, reach, i, F.coalesce(F.get(opens, k + 1), F.size(f))))))

    def union(f: Column, reach: Column, first: Column, after: Column) -> Column:
        one = F.get(f, first)
        token = replace(one["name"], one["match"])
        return F.struct(one["start"].alias("start"), F.get(reach, after - 1).alias("end"),
                        F.when(after - first > 1, merged_token(token)).otherwise(token).alias("token"))

    return bind(found, unions)


def _mask_merged(text: Column, found: Column, replace, merged_token) -> Column:
    """The text with each union replaced by its token.

    Cutting a string by position walks from its start. The text is therefore cut into blocks
    of spans first and each block on its own, so that a long text with very many findings
    does not cost their product.
    """
    def blockwise(m: Column) -> Column:
        def end_before(i: Column) -> Column:
            return F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(0)

        def block(first: Column) -> Column:
            base, last = end_before(first), F.least(first + BLOCK, F.size(m)) - 1
            cut = F.substr(text, base + 1, F.get(m, last)["end"] - base)

            def pieces(b: Column) -> Column:
                return F.array_join(F.transform(F.slice(m, first + 1, F.lit(BLOCK)), lambda s, i: F.concat(
                    F.substr(b["cut"], end_before(first + i) - b["base"] + 1, s["start"] - end_before(first + i)),
                    s["token"])), "")

            return bind(F.struct(cut.alias("cut"), base.alias("base")), pieces)

        firsts = F.sequence(F.lit(0), F.size(m) - 1, F.lit(BLOCK))
        tail = F.substr(text, F.get(m, F.size(m) - 1)["end"] + 1, F.length(text))
        return F.concat(F.array_join(F.transform(firsts, block), ""), tail)

    return bind(_merged_spans(found, replace, merged_token), blockwise)


def mask(text: Column, found: Column, strategy: str = "partial", overlap: str = "merge") -> Column:
    """Text with its findings replaced.

    overlap="merge" joins overlapping spans first and never leaves part of a value behind;
    overlap="reference" applies each span with its original offsets from right to left.
    """
    replace = STRATEGIES[strategy]
    if overlap == "reference":
        masked = _mask_stale(text, found, replace)
    else:
        merged = (lambda token: F.lit(REDACTED)) if strategy == "partial" else (lambda token: token)
        masked = _mask_merged(text, found, replace, merged)
    return F.when(F.size(found) > 0, masked).otherwise(text)


def _quoted(term: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def mask_entities(text: Column, entities: Column, token: str = REDACTED_ENTITY) -> Column:
    """Each entity as a whole word in any case; where several begin, the longest, then the first by text.

    One pass over the text: the entities are the alternatives of one pattern, and what has been
    replaced is not looked at again.
    """
    keyed = F.array_sort(F.transform(F.array_distinct(entities), lambda e: F.struct(
        (-F.length(e)).alias("n"), e.alias("term"))))
    useful = F.filter(keyed, lambda k: F.length(F.trim(k["term"])) > 0)
    either = F.array_join(F.transform(useful, lambda k: _quoted(k["term"])), "|")
    pattern = F.concat(F.lit("(?iU)" + BOUNDARY + "(?:"), either, F.lit(")" + BOUNDARY))
    return F.when(F.coalesce(F.size(useful), F.lit(0)) > 0, F.regexp_replace(text, pattern, F.lit(token))).otherwise(text)


def normalize_masked_email(text: Column) -> Column:
    """Half-masked, then whole e-mail addresses become one token."""
    cleaned = F.regexp_replace(
        F.regexp_replace(text, java_pattern(BROKEN_EMAIL), NORMALIZED_EMAIL),
        java_pattern(WHOLE_EMAIL), NORMALIZED_EMAIL)
    return F.when(F.contains(text, F.lit("@")), cleaned).otherwise(text)


def safe_store_text(action: Column, text: Column, masked: Column) -> Column:
    """What may be stored or logged for a decision."""
    return (
        F.when(action == "block", F.lit(STORED_BLOCKED))
        .when(action == "mask", F.coalesce(F.nullif(masked, F.lit("")), F.lit(STORED_MASKED)))
        .otherwise(text)
    )


def context_text(action: Column, text: Column, masked: Column) -> Column:
    """What may be sent on as conversation context for a decision."""
    return (
        F.when(action == "block", F.lit(CONTEXT_BLOCKED))
        .when(action == "mask", normalize_masked_email(F.coalesce(F.nullif(masked, F.lit("")), text)))
        .otherwise(text)
    )

"""Tokens, BIO labels and entity chunks inside one row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .detection import bind, place_matches
from .patterns import SPACE, WORD
from .textnorm import strip

# ---------------------------------------------------------------------------
# The label list of the tagger and the tokens it is not trusted on.
# ---------------------------------------------------------------------------
TAGGER_LABELS = ["O", "B-NAME", "I-NAME", "B-EMAIL", "I-EMAIL", "B-PHONE", "B-ADDRESS", "B-ID"]
IGNORED_TOKENS = [
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "a", "an", "the", "and", "of", "in", "on", "for", "to", "with", "by",
    "num", "number", "digit", "id", "section", "part", "item",
]
MIN_TOKEN_LENGTH = 2
MAX_DIGIT_RATIO = 0.5
# ---------------------------------------------------------------------------

TOKEN = f"(?U){WORD}+|[^{WORD[1:-1]}{SPACE}]"
NO_SPANS = "array<struct<start:int,end:int,label:string>>"


def tokens(text: Column) -> Column:
    """Words and single marks with their offsets, over the whole text: (token, start, end)."""
    placed = place_matches(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.split(text, TOKEN, -1))
    return F.transform(placed, lambda p: F.struct(
        p["match"].alias("token"), p["start"].alias("start"), p["end"].alias("end")))


def spans_to_bio(token_list: Column, spans: Column, labels: list[str] | None = None,
                 mode: str = "reference") -> Column:
    """(token, start, end, label) per token.

    mode="reference": a token in one span is B-, a token in several is I- of the last one.
    mode="standard": the first token of a span is B-, its other tokens I-; the first span wins.
    Spans with a label outside `labels` are left out.
    """
    known = F.coalesce(spans, F.array().cast(NO_SPANS))
    if labels is not None:
        known = F.filter(known, lambda s: s["label"].isin(*labels))

    def label_of(t: Column, all_spans: Column) -> Column:
        covering = F.filter(all_spans, lambda s: (t["start"] >= s["start"]) & (t["end"] <= s["end"])
                            & (t["start"] < t["end"]))
        if mode == "reference":
            return bind(covering, lambda c: F.when(F.size(c) == 0, "O").when(
                F.size(c) == 1, F.concat(F.lit("B-"), F.get(c, 0)["label"])).otherwise(
                F.concat(F.lit("I-"), F.get(c, F.size(c) - 1)["label"])))
        return bind(covering, lambda c: F.when(F.size(c) == 0, "O").otherwise(F.concat(
            F.when(F.get(c, 0)["start"] == t["start"], "B-").otherwise("I-"), F.get(c, 0)["label"])))

    return bind(known, lambda s: F.transform(token_list, lambda t: F.struct(
        t["token"].alias("token"), t["start"].alias("start"), t["end"].alias("end"), label_of(t, s).alias("label"))))


def decode_labels(ids: Column, labels: list[str] = TAGGER_LABELS) -> Column:
    """Label per id; ids outside the list are dropped."""
    table = F.array(*[F.lit(x) for x in labels])
    return F.filter(F.transform(ids, lambda i: F.get(table, i.cast("int"))), lambda x: x.isNotNull())


def keep_entity(token: Column, label: Column) -> Column:
    """False for tokens that are known to be tagged wrongly. `token` is free of ## marks."""
    digits = F.regexp_count(token, F.lit(r"\p{Nd}"))
    return ((label != "O") & ~F.lower(token).isin(*IGNORED_TOKENS)
            & (F.length(strip(token)) >= MIN_TOKEN_LENGTH) & ~token.rlike(r"^\p{Nd}+$")
            & (digits / F.greatest(F.length(token), F.lit(1)) <= MAX_DIGIT_RATIO)
            & ~token.rlike(r"^[^\p{L}\p{N}]+$"))


def filter_token_labels(labelled: Column) -> Column:
    """(token, label) pairs worth masking, subword marks removed."""
    clean = F.transform(labelled, lambda t: F.struct(
        F.replace(t["token"], F.lit("##"), F.lit("")).alias("token"), t["label"].alias("label")))
    return F.filter(clean, lambda t: keep_entity(t["token"], t["label"]))


def distinct_entities(labelled: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(filter_token_labels(labelled), lambda t: t["token"])))


def bio_to_entities(labelled: Column) -> Column:
    """(type, start, end) of each entity: a B-, or an I- after another type, opens; O or an opening ends."""
    def kind(t: Column) -> Column:
        return F.substr(t["label"], F.lit(3), F.length(t["label"]))

    def chunks(a: Column) -> Column:
        marks = F.transform(a, lambda t, i: F.struct(
            i.alias("i"), (t["label"] == "O").alias("outside"),
            (F.startswith(t["label"], F.lit("B-")) | (F.startswith(t["label"], F.lit("I-")) & (
                (i == 0) | (F.get(a, i - 1)["label"] == "O") | (kind(F.get(a, i - 1)) != kind(t))))).alias("opens")))
        edges = F.filter(marks, lambda m: m["opens"] | m["outside"])
        return bind(edges, lambda e: F.filter(F.transform(e, lambda m, k: F.when(m["opens"], F.struct(
            kind(F.get(a, m["i"])).alias("type"), F.get(a, m["i"])["start"].alias("start"),
            F.get(a, F.coalesce(F.get(e, k + 1)["i"], F.size(a)) - 1)["end"].alias("end")))), lambda x: x.isNotNull()))

    return bind(labelled, chunks)

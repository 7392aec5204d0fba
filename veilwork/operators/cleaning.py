"""Cleaning of text datasets, annotations and user tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.textnorm import first_text, strip, word_count
from .ranking import running_rank

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------
TEXT_FIELDS = ["text", "content", "article", "document"]
ENTITY_TEXT_FIELDS = ["source_text", "text", "masked_text"]
MIN_WORDS = 5
SPLITS = ["train", "validation"]
KEYWORDS = ["email", "phone", "number", "contact", "address"]
DEFAULT_SPAN_LABEL = "PII"
LABELS = ["safe", "unsafe"]
USER_DEFAULTS = {"provider": "local", "role": "user", "is_verified": 0, "last_login_at": None}
USER_TYPES = {"provider": "string", "role": "string", "is_verified": "int", "last_login_at": "string"}
PREVIEW_CHARS = 300
# ---------------------------------------------------------------------------


def coalesce_text(df: DataFrame, fields: list[str] = TEXT_FIELDS, out: str = "text", drop: bool = True) -> DataFrame:
    """One text column from the first non-empty field; rows without any are dropped unless told not to."""
    present = [F.col(f) for f in fields if f in df.columns]
    # A row that ends without text is null for dropping, and the last field's value for keeping.
    text = first_text(*present) if drop else F.coalesce(first_text(*present), present[-1])
    rows = df.select(*[c for c in df.columns if c not in fields], text.alias(out))
    return rows.filter(F.col(out).isNotNull()) if drop else rows


def min_words(df: DataFrame, text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """Stripped texts of at least so many words."""
    return df.withColumn(text, strip(F.coalesce(F.col(text), F.lit("")))).filter(word_count(F.col(text)) >= least)


def with_record_id(df: DataFrame, split: str, index: str, out: str = "id") -> DataFrame:
    """split_index of rows that carry their index, such as the physical lines of a split's files."""
    return df.withColumn(out, F.concat(F.col(split), F.lit("_"), F.col(index).cast("string")))


def assign_record_id(df: DataFrame, split: str, ordinal: str, out: str = "id", width: int = 100_000) -> DataFrame:
    """split_index for rows without an index: all rows of the split are counted from 0 by `ordinal`.

    Call it before filtering, so that skipped rows count.
    """
    ranked = running_rank(df, [split], [F.col(ordinal)], F.floor(F.col(ordinal) / width), "_index")
    return with_record_id(ranked.withColumn("_index", F.col("_index") - 1), split, "_index", out).drop("_index")


def select_splits(df: DataFrame, split: str, names: list[str] = SPLITS) -> DataFrame:
    return df.filter(F.col(split).isin(*names))


def keyword_filter(df: DataFrame, text: str = "text", keywords: list[str] = KEYWORDS, label: str = "safe") -> DataFrame:
    """Rows that contain a keyword in any case, labelled."""
    pattern = "(?iu)" + "|".join(keywords)
    return df.filter(F.coalesce(F.col(text).rlike(pattern), F.lit(False))).withColumn("label", F.lit(label))


def drop_incomplete(df: DataFrame, *needed: str) -> DataFrame:
    return df.dropna(subset=list(needed or ("text", "label")))


def normalize_spans(mask: Column, spans: Column) -> Column:
    """Spans from the first non-empty annotation, bounds as integers, label never empty.

    A span whose bound is missing or no integer is dropped; the row stays.
    """
    chosen = F.when(F.size(mask) > 0, mask).otherwise(spans)
    typed = F.transform(chosen, lambda s: F.struct(
        s["start"].try_cast("int").alias("start"), s["end"].try_cast("int").alias("end"),
        F.coalesce(F.nullif(s["label"], F.lit("")), F.lit(DEFAULT_SPAN_LABEL)).alias("label")))
    good = F.filter(typed, lambda s: s["start"].isNotNull() & s["end"].isNotNull())
    return F.coalesce(good, F.array().cast("array<struct<start:int,end:int,label:string>>"))


def label_encode(df: DataFrame, label: str = "label", out: str = "y", classes: list[str] = LABELS) -> DataFrame:
    """Sorted classes to 0..k-1. A label outside the classes stops the job."""
    code = F.lit(None).cast("int")
    for i, name in enumerate(sorted(classes)):
        code = F.when(F.col(label) == name, i).otherwise(code)
    stop = F.raise_error(F.concat(F.lit("unexpected label: "), F.coalesce(F.col(label), F.lit("null")))).cast("int")
    return df.withColumn(out, F.coalesce(code, stop))


def align_schema(df: DataFrame, defaults: dict = USER_DEFAULTS, types: dict = USER_TYPES) -> DataFrame:
    """Missing columns with their defaults; present ones stay as they are."""
    missing = {c: F.lit(v).cast(types[c]) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def email_key(email: Column) -> Column:
    return strip(F.lower(email))


def unique_emails(users: DataFrame, email: str = "email", user_id: str = "id") -> DataFrame:
    """One user per normalised e-mail: the one with the lowest id. Pre-aggregated before the shuffle."""
    rest = [c for c in users.columns if c not in (email, user_id)]
    keyed = users.withColumn(email, email_key(F.col(email)))
    return keyed.groupBy(email).agg(
        F.min(user_id).alias(user_id), *[F.min_by(F.struct(c), F.col(user_id))[c].alias(c) for c in rest])


def sample_preview(df: DataFrame, label: str, text: str, order: Column, chars: int = PREVIEW_CHARS) -> DataFrame:
    """Per label the text that comes first in `order`, cut for display."""
    picked = df.groupBy(label).agg(F.min_by(F.left(F.col(text), F.lit(chars)), order).alias("preview"))
    return picked


def display_fields(ts: Column, role: Column, name: Column, email: Column) -> dict[str, Column]:
    """Time to the second, role with a capital, the best name for a user."""
    return {
        "shown_time": F.replace(F.substring(ts, 1, 19), F.lit("T"), F.lit(" ")),
        "shown_role": F.concat(F.upper(F.substring(role, 1, 1)), F.lower(F.substr(role, F.lit(2), F.length(role)))),
        "shown_name": F.coalesce(first_text(name, email), F.lit("User")),
    }


def json_text(value: Column) -> Column:
    """The text of a JSON value: strings decoded, others as written; null if it is no JSON or null."""
    listed = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>", {"allowSingleQuotes": "false"})
    return F.when(F.size(listed) == 1, F.get(listed, 0))


def policy_event_view(events: DataFrame) -> DataFrame:
    """Policy events for display: first finding only, readable defaults, times parsed.

    A JSON list of findings shows its first one, other text its first character. Raw content
    that is JSON is decoded, other content stays as it is.
    """
    found, raw, user = F.col("findings"), F.col("raw_content"), F.col("user_id")
    decoded = F.from_json(found, "array<string>", {"allowSingleQuotes": "false"})
    is_list = F.trim(found).startswith("[") & decoded.isNotNull()
    one = F.when(F.trim(found).startswith('"'), json_text(found))
    first = F.when(F.coalesce(found, F.lit("")) == "", "").when(
        is_list, F.coalesce(F.get(decoded, 0), F.lit(""))).otherwise(F.substring(F.coalesce(one, found), 1, 1))
    return events.select(
        F.col("id").alias("event_id"),
        F.when(user.isNull() | (user == 0), "Guest").otherwise(user.cast("string")).alias("user_id"),
        "policy_id", "action", first.alias("findings"),
        F.coalesce(first_text(F.col("ip_address")), F.lit("Unknown")).alias("ip"),
        F.coalesce(first_text(F.col("user_agent")), F.lit("Unknown")).alias("user_agent"),
        F.coalesce(json_text(raw), raw).alias("user_input"), "created_at")

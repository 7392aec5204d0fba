"""White space, words, timestamps and other small text matters."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .patterns import SPACE

# All characters that count as white space, by rule.
SPACE_CHARS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace())


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"(?U)[^{SPACE}]+")), F.lit(0))


def first_text(*candidates: Column) -> Column:
    """First non-empty candidate; an empty string counts as missing."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def escape_newlines(text: Column) -> Column:
    """One record, one line: each newline becomes backslash-n; null becomes empty."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit("\\n"))


ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?([+-]\d{2}:?\d{2}|Z)?)?$"


def parse_time(value: Column) -> Column:
    """ISO text with Z, an offset or none (meaning UTC); null if it is anything else."""
    text = value.cast("string")
    time = F.regexp_extract(text, r"[T ](\d{2}(?::\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?)", 1)
    time = F.concat(time, F.substr(F.lit("00:00:00"), F.length(time) + 1, F.greatest(8 - F.length(time), F.lit(0))))
    offset = F.regexp_extract(text, r"([+-]\d{2}):?\d{2}$", 1)
    minutes = F.regexp_extract(text, r"[+-]\d{2}:?(\d{2})$", 1)
    zone = F.when((offset != "") & (F.length(text) > 10), F.concat(offset, F.lit(":"), minutes)).otherwise("+00:00")
    full = F.concat(F.substring(text, 1, 10), F.lit(" "), time, zone)
    return F.when(text.rlike(ISO), full.try_cast("timestamp"))


def parse_epoch(value: Column) -> Column:
    """Epoch seconds; 0 counts as missing."""
    return F.when(value != 0, F.timestamp_micros((value * 1000000).cast("bigint")))


def iso_text(ts: Column) -> Column:
    """Timestamp as ISO text in the session's zone, microseconds included."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str, str]:
    """Letters that lose a mark (from, to) and marks that vanish, by rule from their decomposition."""
    source, target, marks = [], [], []
    for code in range(0x80, sys.maxunicode + 1):
        char = chr(code)
        if 0xD800 <= code <= 0xDFFF:
            continue
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if plain == "":
            marks.append(char)
        elif plain != char and len(plain) == 1:
            source.append(char)
            target.append(plain)
    return "".join(source), "".join(target), "".join(marks)


def strip_accents(text: Column) -> Column:
    """Letters without their marks.

    Characters that decompose into several (ligatures, Korean syllables) stay whole, so that
    this needs no Python; `strip_accents_exact` splits them too.
    """
    source, target, marks = _accent_table()
    plain = F.translate(text, source + marks, target)
    return F.when(text.rlike(r"[^\x00-\x7f]"), plain).otherwise(text)


@F.pandas_udf(T.StringType())
def strip_accents_exact(text: pd.Series) -> pd.Series:
    """Full compatibility decomposition without combining marks."""
    def plain(value):
        return "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c))

    return text.map(plain, na_action="ignore")

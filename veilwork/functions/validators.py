"""Checks a candidate must pass after its pattern matched. All run as native columns."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, functions as F


@lru_cache(maxsize=1)
def _decimal_digits() -> tuple[str, str]:
    """Every decimal digit of Unicode beyond ASCII and its ASCII value, by rule."""
    found = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.decimal(c)) for c in found)


def ascii_digits(value: Column) -> Column:
    """Digits of any script written with 0-9."""
    source, target = _decimal_digits()
    return F.when(value.rlike(r"[^\x00-\x7f]"), F.translate(value, source, target)).otherwise(value)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(ascii_digits(value), "[^0-9]", "")


def luhn_ok(value: Column) -> Column:
    """13 to 19 digits whose Luhn sum is a multiple of ten; other characters are ignored."""
    digits = digits_of(value)

    def add(state: Column, digit: Column) -> Column:
        doubled = digit.cast("int") * 2
        worth = F.when(state["odd"], doubled - F.when(doubled > 9, 9).otherwise(0)).otherwise(digit.cast("int"))
        return F.struct((state["total"] + worth).alias("total"), (~state["odd"]).alias("odd"))

    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("total"), F.lit(False).alias("odd")),
        add,
        lambda s: s["total"],
    )
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


def ipv4_ok(value: Column) -> Column:
    """Four dot-separated numbers of 0 to 255."""
    parts = F.split(ascii_digits(value), r"\.", -1)
    in_range = F.forall(parts, lambda p: F.coalesce(p.try_cast("int").between(0, 255), F.lit(False)))
    return (F.size(parts) == 4) & in_range


def ssn_ok(value: Column) -> Column:
    """ddd-dd-dddd outside the area, group and serial numbers that are never issued."""
    area, group, serial = F.substring(value, 1, 3), F.substring(value, 5, 2), F.substring(value, 8, 4)
    shaped = value.rlike(r"^\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}$")
    never = area.isin("000", "666") | area.between("900", "999") | (group == "00") | (serial == "0000")
    return shaped & ~never


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "luhn": luhn_ok,
    "ipv4": ipv4_ok,
    "ssn": ssn_ok,
}


def register_validator(name: str, check: Callable[[Column], Column]) -> None:
    """Make a Column -> boolean Column check available to pattern specs under a name."""
    VALIDATORS[name] = check

"""Leaves of row filters. A leaf on a missing field is false, so its negation is true; combine with &, | and ~."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number and as a time in text.
NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
ISO = r"^\d{4}-\d{2}-\d{2}([T ].*)?$"

OPS = {"==": Column.__eq__, "!=": Column.__ne__, ">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__}


def _false_if_missing(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def has(text: Column, word: str) -> Column:
    """The word, in any case, with no letter, digit or underscore of ASCII next to it."""
    return _false_if_missing(text.cast("string").rlike(f"(?i)(?<![A-Za-z0-9_])\\Q{word}\\E(?![A-Za-z0-9_])"))


def contains(text: Column, part: str) -> Column:
    """The part, in any case."""
    return _false_if_missing(F.contains(F.lower(text.cast("string")), F.lit(part.lower())))


def matches(text: Column, pattern: str) -> Column:
    """The (Java) pattern somewhere in the text, case-sensitive."""
    return _false_if_missing(text.cast("string").rlike(pattern))


def as_number(value: Column, is_text: bool) -> Column:
    """The number that a value is or spells; null for others, booleans among them."""
    return F.when(value.rlike(NUMBER), F.trim(value).try_cast("double")) if is_text else value.cast("double")


def as_time(value: Column, is_text: bool) -> Column:
    """The time that ISO text or a date or timestamp column gives; null for others."""
    return F.when(value.rlike(ISO), value.try_cast("timestamp")) if is_text else value.cast("timestamp")


def compare(value: Column, op: str, other: object, kind: str = "string") -> Column:
    """``value op other`` by the first rung that both sides reach: as numbers, as times, as equal or different text.

    ``kind`` is the column's type: "string", "boolean", "time", or else a number. Text that spells a number counts as
    one; an order between values that are neither numbers nor times is false.
    """
    if isinstance(other, bool) or kind == "boolean":
        same = F.lower(value.cast("string")) if kind == "boolean" else value.cast("string")
        return _false_if_missing(OPS[op](same, F.lit(str(other).lower() if isinstance(other, bool) else str(other)))) if op in ("==", "!=") else F.lit(False)
    text = str(other)
    rungs = F.lit(None).cast("boolean")
    if kind not in ("string", "time"):
        if isinstance(other, (int, float)) or re.match(NUMBER, text):
            return _false_if_missing(OPS[op](value, F.lit(float(text)) if not isinstance(other, int) else F.lit(other)))
    elif re.match(NUMBER, text) and kind == "string":
        number = as_number(value, True)
        rungs = F.when(number.isNotNull(), OPS[op](number, F.lit(float(text))))
    elif re.match(ISO, text):
        time = as_time(value, kind == "string")
        rungs = F.when(time.isNotNull(), OPS[op](time, F.lit(text).cast("timestamp")))
    if op in ("==", "!="):
        rungs = F.coalesce(rungs, OPS[op](value.cast("string"), F.lit(text)))
    return _false_if_missing(rungs)


def present(value: Column) -> Column:
    return value.isNotNull()

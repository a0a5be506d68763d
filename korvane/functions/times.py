"""Times from text or epoch numbers, and time bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import ISO

#: Seconds of each bin.
BINS = {"1m": 60, "5m": 300, "15m": 900, "1h": 3600, "6h": 21600, "1d": 86400}


def epoch(value: Column, kind: str) -> Column:
    """Seconds since 1970 UTC of ISO text, a timestamp or an epoch number (1e11 and more are milliseconds)."""
    if kind == "string":
        return F.when(value.rlike(ISO), F.unix_micros(value.try_cast("timestamp")) / 1e6)
    if kind == "time":
        return F.unix_micros(value.cast("timestamp")) / 1e6
    return F.when(value >= 1e11, value / 1000).otherwise(value.cast("double"))


def bin_start(value: Column, width: str, kind: str = "time") -> Column:
    """The start of the value's bin, in seconds since 1970 UTC; null if it is no time."""
    size = BINS[width]
    return (F.floor(epoch(value, kind) / size) * size).cast("long")


def bin_label(start: Column, width: str) -> Column:
    """``HH:MM`` for bins under a day, so days share labels; ``YYYY-MM-DD`` for days."""
    return F.date_format(F.timestamp_seconds(start), "yyyy-MM-dd" if width == "1d" else "HH:mm")


def coerce_date(text: Column) -> Column:
    """ISO text for dates as people write them: ``Jan 15 2026``, ``15 Jan 2026``, ``2026/01/15``, ``01/15/2026``."""
    spaced = F.regexp_replace(F.trim(text), r"[,\s]+", " ")
    forms = ["yyyy-MM-dd", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy/M/d", "M/d/yyyy"]
    return F.coalesce(*[F.try_to_timestamp(spaced, F.lit(f)) for f in forms]).cast("date").cast("string")


def ambiguous_date(text: Column) -> Column:
    """Whether ``a/b/year`` could be read with the day first as well."""
    day, month = (F.regexp_extract(text, r"^\s*(\d{1,2})/(\d{1,2})/\d{4}\s*$", i).try_cast("int") for i in (1, 2))
    return F.coalesce((day <= 12) & (month <= 12) & (day != month), F.lit(False))

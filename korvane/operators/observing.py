"""Counts that come with a pass: how many rows a filter kept, which fields were missing or no numbers, what is not a
record. They are observed by the tasks that do the work; no job of their own counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.predicates import NUMBER


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


@dataclass
class Observed:
    """A table with counts that are known once an action has gone through all of it. Spark fills them after the first one;
    an action that stops early, such as ``limit``, counts what it has seen."""

    rows: DataFrame
    before: Observation
    after: Observation | None
    fields: dict[str, str]

    def counts(self) -> dict[str, int]:
        """seen, kept, and for each field missing and, if it should be one, no number. Waits for the first action."""
        return {**self.before.get, **(self.after.get if self.after else {})}

    def table(self) -> DataFrame:
        """The counts as rows (field, missing, non_numeric); ``*`` has seen and kept instead. The driver makes it from the
        numbers it has."""
        c = self.counts()
        rows = [("*", None, None, c["seen"], c.get("kept"))]
        rows += [(f, c[f"missing:{f}"], c.get(f"non_numeric:{f}"), None, None) for f in self.fields]
        return self.rows.sparkSession.createDataFrame(rows, "field string, missing long, non_numeric long, seen long, kept long")

    def notes(self, top: int = 3) -> list[str]:
        """What a user should know, the fields with most rows first."""
        c = self.counts()
        said = [f"{c['kept']:,} of {c['seen']:,} matched"] if "kept" in c else [f"{c['seen']:,} rows"]
        for label, key in (("missing", "missing"), ("non-numeric", "non_numeric")):
            most = sorted(((c.get(f"{key}:{f}", 0), f) for f in self.fields), key=lambda x: (-x[0], x[1]))
            said += [f"field '{f}' {label} on {n:,} rows" for n, f in most[:top] if n]
        return said


def observe(df: DataFrame, fields: dict[str, str], name: str, predicate: Column | None = None) -> Observed:
    """``df``, or with a ``predicate`` the rows that it holds for, with counts of all rows: for each column in ``fields``
    on how many it is missing and, where its kind is "number", on how many it is there but no number (text counts as one
    if it spells one). ``name`` tells observations of a session apart."""
    counts = [F.count(F.lit(1)).alias("seen")]
    for f, kind in fields.items():
        c = F.col(f"`{f}`")
        counts.append(_count(c.isNull()).alias(f"missing:{f}"))
        if kind == "number":
            text = c.cast("string")
            counts.append(_count(c.isNotNull() & ~text.rlike(NUMBER) & ~F.lower(text).isin("nan", "infinity", "-infinity")).alias(f"non_numeric:{f}"))
    before = Observation(f"{name}-before")
    rows, after = df.observe(before, *counts), None
    if predicate is not None:
        after = Observation(f"{name}-after")
        rows = rows.where(predicate).observe(after, F.count(F.lit(1)).alias("kept"))
    return Observed(rows, before, after, fields)


class MixedRows(ValueError):
    """Records and plain lines in one input that should hold one kind."""


@dataclass
class Census:
    """Lines with the record that each one is, if it is one, and how many there are of each kind."""

    rows: DataFrame
    seen: Observation

    def counts(self) -> dict[str, int]:
        return dict(self.seen.get)

    def require_one_kind(self) -> None:
        """An error if there were both records and plain lines. Waits for the first action; the error names the first
        plain line or record by the smaller kind's least place."""
        c = self.counts()
        if c["records"] and c["plain"]:
            odd, kind = (c["first_plain"], "a plain line") if c["plain"] <= c["records"] else (c["first_record"], "a record")
            raise MixedRows(f"{c['records']:,} records and {c['plain']:,} plain lines; {kind} at: {odd}")


def census(lines: DataFrame, name: str) -> Census:
    """``lines`` (text and further columns) with ``data``, the line as a variant if it is a JSON object, and counts of
    records and plain lines taken in the same pass."""
    data = F.try_parse_json("text")
    is_record = F.coalesce(F.schema_of_variant(data).startswith("OBJECT"), F.lit(False))
    seen = Observation(f"{name}-census")
    where = F.concat_ws(": ", F.col("__source") if "__source" in lines.columns else F.lit(None).cast("string"), F.substring("text", 1, 80))
    rows = lines.withColumn("data", F.when(is_record, data))
    rows = rows.observe(
        seen,
        F.count(F.lit(1)).alias("seen"), _count(F.col("data").isNotNull()).alias("records"), _count(F.col("data").isNull()).alias("plain"),
        F.min(F.when(F.col("data").isNull(), where)).alias("first_plain"), F.min(F.when(F.col("data").isNotNull(), where)).alias("first_record"),
    )
    return Census(rows, seen)

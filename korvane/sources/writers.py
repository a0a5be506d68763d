"""Files from tables: JSON lines, text, CSV, one file for each value of a template."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def record_text(df: DataFrame) -> Column:
    """Each row as compact JSON, nulls kept."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def jsonl(df: DataFrame, path: str) -> None:
    df.select(record_text(df).alias("value")).write.text(path)


def text(df: DataFrame, column: str, path: str) -> None:
    """One line for each row; line ends inside become spaces."""
    df.select(F.regexp_replace(F.col(column), r"\r\n?|\n", " ").alias("value")).write.text(path)


def csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """CSV with a header; nested values as JSON, rank columns last. In TSV, tabs and line ends in text become spaces."""
    last = [c for c in ("__score", "__rank", "__distance") if c in df.columns]
    columns = []
    for name in [c for c in df.columns if c not in last] + last:
        kind, c = df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        elif isinstance(kind, T.StringType) and sep == "\t":
            c = F.regexp_replace(c, r"[\t\r\n]+", " ")
        columns.append(c.alias(name))
    df.select(*columns).write.csv(path, header=True, sep=sep, escape='"')


#: What a name's ending says about the form.
FORMS = {"jsonl": "jsonl", "ndjson": "jsonl", "json": "jsonl", "csv": "csv", "tsv": "tsv", "txt": "text", "text": "text", "parquet": "parquet"}


def form_of(df: DataFrame, path: str, form: str | None = None) -> str:
    """The form to write in: the one asked for, or what the path's ending says, or text for plain lines (one column
    ``text``) and JSON lines for anything else. CSV and TSV need named fields, text needs one column of it."""
    ending = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    plain = [c for c in df.columns if not c.startswith("__")] == ["text"]
    found = form or FORMS.get(ending) or ("text" if plain else "jsonl")
    if found not in set(FORMS.values()):
        raise ValueError(f"no form {found!r}; there are {', '.join(sorted(set(FORMS.values())))}")
    if found in ("csv", "tsv") and plain:
        raise ValueError(f"plain lines have no fields for {found}")
    if found == "text" and not plain:
        raise ValueError(f"text is one column, these are {', '.join(df.columns)}")
    return found


def write(df: DataFrame, path: str, form: str | None = None) -> str:
    """Write ``df`` in the form that ``form_of`` finds, and say which."""
    found = form_of(df, path, form)
    if found == "parquet":
        df.write.parquet(path)
    elif found == "text":
        text(df, "text", path)
    elif found == "jsonl":
        jsonl(df, path)
    else:
        csv(df, path, "\t" if found == "tsv" else ",")
    return found


def target(template: str) -> Column:
    """The template's value for each row: ``{column}`` is a column's text."""
    parts = [p for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*[F.coalesce(F.col(p[1:-1]).cast("string"), F.lit("")) if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in parts])


def by_template(df: DataFrame, path: str, template: str, order: str, field: str | None = None) -> None:
    """Rows as lines below ``path``, in a folder for each value of the template, in the order of ``order``.

    A large target is spread over several files by range, so it is no one task's; the folder holds them in order.
    """
    value = F.col(field).cast("string") if field else record_text(df)
    routed = df.select(target(template).alias("target"), F.col(order).alias("_order"), value.alias("value"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed.repartitionByRange(parts, "target", "_order").sortWithinPartitions("target", "_order").drop("_order").write.partitionBy("target").text(path)


def readable(df: DataFrame, rows: int = 20, width: int = 200) -> str:
    """Blocks of "field: value" for the first rows, for people to look at."""
    blocks = []
    for r in df.limit(rows).collect():
        blocks.append("\n".join(f"{k}: {str(v)[:width]}{'...' if len(str(v)) > width else ''}" for k, v in r.asDict().items()))
    return "\n\n".join(blocks)


def bars(tally: DataFrame, width: int = 40, rows: int = 100) -> str:
    """A tally (value, count) as bars of "#", the longest ``width`` long."""
    found = tally.limit(rows).collect()
    most = max([r["count"] for r in found], default=1)
    wide = max([len(str(r["value"])) for r in found], default=0)
    return "\n".join(f"{str(r['value']).ljust(wide)} {'#' * max(1, round(width * r['count'] / most))} {r['count']}" for r in found)


def svg(tally: DataFrame, title: str = "", rows: int = 100) -> str:
    """A tally as an SVG bar chart."""
    from xml.sax.saxutils import escape

    found = tally.limit(rows).collect()
    most = max([r["count"] for r in found], default=1)
    lines = [f"<svg xmlns='http://www.w3.org/2000/svg' width='640' height='{40 + 24 * len(found)}'><text x='8' y='20'>{escape(title)}</text>"]
    for i, r in enumerate(found):
        y = 32 + 24 * i
        lines.append(f"<text x='8' y='{y + 14}'>{escape(str(r['value']))}</text><rect x='200' y='{y}' width='{400 * r['count'] / most:.1f}' height='18' fill='#47a'/><text x='{204 + 400 * r['count'] / most:.1f}' y='{y + 14}'>{r['count']}</text>")
    return "".join(lines) + "</svg>"

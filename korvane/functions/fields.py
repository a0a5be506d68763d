"""Fields by path: ``name``, ``a.b``, ``items[0].total``, ``user['first name']``, negative indexes from the end.

A column (or key) with exactly the path's text wins over traversal; whatever is missing is null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a path is made of.
HOP = re.compile(r"\.?([^.\[\]']+)|\[(-?\d+)\]|\['([^']*)'\]")


def hops(path: str) -> list[str | int]:
    """The names and indexes of a path."""
    found = [int(m[2]) if m[2] is not None else (m[1] if m[1] is not None else m[3]) for m in HOP.finditer(path)]
    if not path or HOP.sub("", path):
        raise ValueError(f"not a field path: {path!r}")
    return found


def _item(c: Column, i: int) -> Column:
    return F.try_element_at(c, F.lit(i + 1 if i >= 0 else i))


def field(df: DataFrame, path: str) -> Column:
    """The field of a typed table; null where it is missing."""
    if path in df.columns:
        return F.col(f"`{path}`")
    kind: T.DataType = df.schema
    out: Column | None = None
    for hop in hops(path):
        if isinstance(hop, str) and isinstance(kind, T.StructType) and hop in kind.names:
            out, kind = (F.col(f"`{hop}`") if out is None else out.getField(hop)), kind[hop].dataType
        elif isinstance(hop, str) and isinstance(kind, T.MapType):
            out, kind = F.try_element_at(out, F.lit(hop)), kind.valueType
        elif isinstance(hop, int) and isinstance(kind, T.ArrayType):
            out, kind = _item(out, hop), kind.elementType
        else:
            return F.lit(None)
    return out


def json_field(record: Column, path: str, kind: str = "string") -> Column:
    """The field of a JSON record given as text: null if the text is no JSON or the field is missing."""
    data = F.try_parse_json(record)

    def get(at: str, what: str) -> Column:
        return F.try_variant_get(data, at, what)

    exact = "$['" + path.replace("'", "") + "']" if "'" not in path else None
    parts = hops(path)
    here, out = "$", None
    for hop in parts:
        if isinstance(hop, int) and hop < 0:
            out = F.try_element_at(get(here, "array<variant>") if out is None else F.try_variant_get(out, here, "array<variant>"), F.lit(hop))
            here = "$"
        else:
            here += f"[{hop}]" if isinstance(hop, int) else f"['{hop}']"
    walked = get(here, kind) if out is None else F.try_variant_get(out, here, kind)
    return F.coalesce(get(exact, kind), walked) if exact and len(parts) > 1 else walked


def project(df: DataFrame, paths: list[str]) -> DataFrame:
    """The fields in order, each a column named by its path; null where missing."""
    return df.select(*[field(df, p).alias(p) for p in paths])


def bare(df: DataFrame) -> DataFrame:
    """Without the columns whose names begin with two underscores."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("__")])

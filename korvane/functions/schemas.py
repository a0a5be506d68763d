"""Record schemas (a part of JSON Schema, as dictionaries) turned into columns: typed values with the usual slips of
answers coerced, what is wrong with a record, and an example."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import coerce_date

Schema = dict[str, Any]

#: What spells a whole number, a number, a truth value and an ISO time.
WHOLE, NUMBER = r"^\s*[+-]?\d+\s*$", r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
SCALARS = ["string", "number", "integer", "boolean"]
_NONE = "array<string>"


def record_schema(fields: dict[str, Schema | str | None], required: list[str] | None = None) -> Schema:
    """A closed object schema from fields: a type's name, a property, or None for any scalar."""
    plain = {n: {"type": p} if isinstance(p, str) else dict(p) if p is not None else {"type": [*SCALARS, "array"]} for n, p in fields.items()}
    return {"type": "object", "properties": plain, "required": list(fields) if required is None else required, "additionalProperties": False}


def opened(schema: Schema) -> Schema:
    """The schema to check rows with instead of answers: other fields may be there, and nullable ones may be absent."""
    needed = [n for n in schema.get("required", []) if "null" not in _bases(schema.get("properties", {}).get(n, {}))]
    return {**schema, "additionalProperties": True, "required": needed}


def _bases(prop: Schema) -> list[str]:
    kind = prop.get("type")
    return [kind] if isinstance(kind, str) else list(kind or [])


def _one(prop: Schema) -> str:
    """A property's type next to null; "any" if there are several."""
    bases = [b for b in _bases(prop) if b != "null"]
    return bases[0] if len(bases) == 1 else "any"


def field(record: Column, name: str) -> Column:
    """A variant's field as a variant: null if it is missing, a variant null if it is null."""
    if "'" in name or "\\" in name:  # paths can't spell these
        return F.try_element_at(F.try_variant_get(record, "$", "map<string, variant>"), F.lit(name))
    return F.try_variant_get(record, f"$['{name}']", "variant")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _when_text(v: Column, pattern: str) -> Column:
    return (_kind(v) == "STRING") & _text(v).rlike(pattern)


def _is_number(v: Column) -> Column:
    return _kind(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")


def _datetime(text: Column) -> Column:
    """ISO text of a time as people write them: ISO, or a date (then midnight), or a date and a time of day."""
    iso = F.when(text.rlike(r"^\s*\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?\s*(Z|[+-]\d\d:?\d\d)?\s*$"), F.regexp_replace(F.trim(text), r"^(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d)(?!:)", "$1T$2:00"))
    iso = F.when(iso.try_cast("timestamp").isNotNull(), F.regexp_replace(F.regexp_replace(iso, "^(.{10}) ", "$1T"), "Z$", "+00:00"))
    day = coerce_date(F.regexp_extract(text, r"^(.*?)(?:\s+\d{1,2}:\d\d(?::\d\d)?)?\s*$", 1))
    clock = F.regexp_extract(text, r"\s(\d{1,2}:\d\d(?::\d\d)?)\s*$", 1)
    clock = F.when(clock == "", "00:00:00").otherwise(F.concat(F.lpad(F.split(clock, ":")[0], 2, "0"), F.lit(":"), F.split(clock, ":")[1], F.lit(":"), F.coalesce(F.get(F.split(clock, ":"), F.lit(2)), F.lit("00"))))
    return F.coalesce(iso, F.concat(day, F.lit("T"), clock))


def value(v: Column, prop: Schema) -> Column:
    """The variant as the property's type: null where it is null or can't be read so.

    Text that spells a whole number, a number or a truth value counts as one, whole floating-point numbers as whole; dates
    and times become ISO text; fields that an object schema doesn't name are dropped. Any scalar is its text, a list or
    object its JSON.
    """
    kind = _one(prop)
    if kind == "object":
        return F.when(_kind(v).startswith("OBJECT"), F.struct(*[value(field(v, n), p).alias(n) for n, p in prop.get("properties", {}).items()]))
    if kind == "array":
        elements = F.try_variant_get(v, "$", "array<variant>")
        return F.when(_kind(v).startswith("ARRAY"), F.transform(elements, lambda e: value(e, prop.get("items", {}))))
    if kind == "integer":
        whole = F.try_variant_get(v, "$", "double")
        return F.when(_kind(v) == "BIGINT", F.try_variant_get(v, "$", "long")).when(_when_text(v, WHOLE), F.trim(_text(v)).try_cast("long")).when(_is_number(v) & (whole == F.floor(whole)) & (F.abs(whole) < 2**53), whole.try_cast("long"))
    if kind == "number":
        return F.when(_is_number(v), F.try_variant_get(v, "$", "double")).when(_when_text(v, NUMBER), F.trim(_text(v)).try_cast("double"))
    if kind == "boolean":
        return F.when(_kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(_when_text(v, r"(?i)^\s*(true|false)\s*$"), F.lower(F.trim(_text(v))) == "true")
    if kind == "string" or "enum" in prop:
        text = F.when(_kind(v) == "STRING", _text(v))
        return {"date": coerce_date, "date-time": _datetime}.get(prop.get("format"), lambda t: t)(text)
    scalar = _kind(v).rlike("^(STRING|BOOLEAN|BIGINT|DOUBLE|FLOAT|DECIMAL)")
    return F.when(scalar, _text(v)).when(_kind(v) != "VOID", F.to_json(v))


def _say(bad: Column, path: Column, text: str) -> Column:
    """One complaint if ``bad`` holds, else none."""
    return F.when(F.coalesce(bad, F.lit(False)), F.array(F.concat(path, F.lit(text)))).otherwise(F.array().cast(_NONE))


def problems(v: Column, prop: Schema, path: Column | None = None) -> Column:
    """What is wrong with a variant that should be of ``prop``, as an array of "path: complaint", empty if nothing is.
    A missing value (null) is complained about by its object, not here."""
    path = F.lit("record") if path is None else path
    kind, found = _one(prop), value(v, prop)
    is_null, may_be_null = _kind(v) == "VOID", "null" in _bases(prop)
    present = v.isNotNull() & ~is_null
    named = {"integer": "a whole number", "number": "a number", "boolean": "true or false", "string": "text", "array": "a list", "object": "an object"}.get(kind, "a value")
    named = {"date": "a date", "date-time": "a time"}.get(prop.get("format"), named)
    said = [_say(is_null & F.lit(not may_be_null), path, ": is null")]
    if kind != "any" or "enum" in prop:
        said.append(_say(present & found.isNull(), path, f": is not {named}"))
    elif kind == "any" and "object" not in _bases(prop) and prop.get("type"):
        said.append(_say(present & _kind(v).startswith("OBJECT"), path, ": is an object"))
    if "enum" in prop:
        said.append(_say(found.isNotNull() & ~found.isin(*map(str, prop["enum"])), path, ": is none of the values"))
    if "minimum" in prop:
        said.append(_say(found < prop["minimum"], path, f": is below {prop['minimum']}"))
    if "maximum" in prop:
        said.append(_say(found > prop["maximum"], path, f": is above {prop['maximum']}"))
    if "minLength" in prop:
        said.append(_say(F.length(found) < prop["minLength"], path, f": is shorter than {prop['minLength']}"))
    if "maxLength" in prop:
        said.append(_say(F.length(found) > prop["maxLength"], path, f": is longer than {prop['maxLength']}"))
    if kind == "array" and prop.get("items"):
        elements = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
        said.append(F.flatten(F.transform(elements, lambda e, i: problems(e, prop["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))))
    if kind == "object":
        fields = prop.get("properties", {})
        for n, p in fields.items():
            inner = field(v, n)
            here = F.lit(n) if path is None else F.concat(path, F.lit(f".{n}"))
            said.append(problems(inner, p, here))
            if n in prop.get("required", []):
                said.append(_say(_kind(v).startswith("OBJECT") & inner.isNull(), here, ": is missing"))
    return reduce(lambda a, b: F.concat(a, b), said)


def extra_fields(v: Column, schema: Schema) -> Column:
    """Names of an object's own fields that the schema doesn't have, sorted."""
    names = F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))
    return F.array_sort(F.array_except(F.coalesce(names, F.array().cast(_NONE)), F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast(_NONE)))


def checked(json: Column, schema: Schema, strict: bool = False) -> Column:
    """(valid, problems) of JSON text, as a check of rows: open to other fields unless ``strict``. Text that holds no
    object has one problem."""
    v = F.try_parse_json(json)
    wrong = problems(v, opened(schema))
    if strict:
        wrong = F.concat(wrong, F.transform(extra_fields(v, schema), lambda n: F.concat(F.lit("record."), n, F.lit(": is not in the schema"))))
    wrong = F.when(F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False)), wrong).otherwise(F.array(F.lit("record: is not a JSON object")))
    return F.struct((F.size(wrong) == 0).alias("valid"), wrong.alias("problems"))


def answered(json: Column, schema: Schema) -> Column:
    """(record, problems) of a model's answer as JSON text: the typed record, closed to other fields, if nothing is wrong
    with it."""
    v = F.try_parse_json(json)
    wrong = F.when(F.coalesce(_kind(v).startswith("OBJECT"), F.lit(False)), problems(v, schema)).otherwise(F.array(F.lit("record: is not a JSON object")))
    return F.struct(F.when(F.size(wrong) == 0, value(v, schema)).alias("record"), wrong.alias("problems"))


def example(schema: Schema) -> Any:
    """A record that the schema accepts, always the same; null for what it doesn't describe."""
    if schema.get("enum"):
        return schema["enum"][0]
    bases = [b for b in _bases(schema) if b != "null"]
    kind = bases[0] if bases else None
    if kind == "object":
        return {n: example(p) for n, p in schema.get("properties", {}).items()}
    if kind == "array":
        return [example(schema["items"])] if schema.get("items") else []
    if kind == "string":
        if schema.get("format"):
            return {"date": "2026-01-15", "date-time": "2026-01-15T14:30:00"}.get(schema["format"], "text")
        return "text".ljust(schema.get("minLength", 0), "x")[: schema.get("maxLength")]
    if kind in ("integer", "number"):
        low = min(max(0, schema.get("minimum", 0)) if "minimum" not in schema else schema["minimum"], schema.get("maximum", float("inf")))
        return int(-(-low // 1)) if kind == "integer" else low
    return True if kind == "boolean" else None

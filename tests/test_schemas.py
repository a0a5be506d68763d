"""Schemas as columns: coercion, complaints, checks and examples."""

import json

import pytest
from pyspark.sql import functions as F

from korvane.functions import schemas

INVOICE = schemas.record_schema(
    {
        "vendor": {"type": "string", "minLength": 2, "maxLength": 9},
        "total": {"type": "number", "minimum": 0, "maximum": 1000},
        "count": "integer",
        "paid": {"type": ["boolean", "null"]},
        "due": {"type": "string", "format": "date"},
        "at": {"type": ["string", "null"], "format": "date-time"},
        "status": {"enum": ["open", "done"]},
        "tags": {"type": "array", "items": {"type": "string"}},
        "lines": {"type": "array", "items": schemas.record_schema({"sku": "string", "n": "integer"})},
        "any": None,
    }
)
GOOD = {"vendor": "Acme", "total": 12.5, "count": 3, "paid": True, "due": "2026-01-15", "at": "2026-01-15T14:30:00", "status": "open", "tags": ["a", "b"], "lines": [{"sku": "x", "n": 1}], "any": 7}


def read(spark, record):
    text = record if isinstance(record, str) else json.dumps(record)
    r = spark.createDataFrame([(text,)], "j string").select(schemas.answered(F.col("j"), INVOICE).alias("a")).first().a
    return (r.record.asDict(recursive=True) if r.record else None), r.problems


def test_typed_record(spark):
    got, wrong = read(spark, GOOD)
    assert wrong == [] and got == {**GOOD, "any": "7"}


def test_coercion(spark):
    got, wrong = read(spark, {**GOOD, "total": " 12.50 ", "count": "-3", "paid": "FALSE", "due": "Jan 15 2026", "at": "2026-01-15 14:30", "any": [1, "x"], "more": 1, "lines": [{"sku": "x", "n": "4", "more": 2}, {"sku": "y", "n": 2.0}]})
    assert wrong == []
    assert got == {**GOOD, "total": 12.5, "count": -3, "paid": False, "at": "2026-01-15T14:30:00", "any": '[1,"x"]', "lines": [{"sku": "x", "n": 4}, {"sku": "y", "n": 2}]}
    got, wrong = read(spark, {**GOOD, "paid": None, "at": None})
    assert wrong == [] and got["paid"] is None and got["at"] is None
    assert read(spark, {**GOOD, "at": "Jan 15 2026"})[0]["at"] == "2026-01-15T00:00:00"
    assert read(spark, {**GOOD, "at": "15 Jan 2026 9:05"})[0]["at"] == "2026-01-15T09:05:00"


@pytest.mark.parametrize(
    "change, complaint",
    [
        ({"total": "many"}, "record.total: is not a number"),
        ({"total": -1}, "record.total: is below 0"),
        ({"total": 1001}, "record.total: is above 1000"),
        ({"count": 2.5}, "record.count: is not a whole number"),
        ({"count": None}, "record.count: is null"),
        ({"vendor": "A"}, "record.vendor: is shorter than 2"),
        ({"vendor": "Acme and sons"}, "record.vendor: is longer than 9"),
        ({"vendor": 5}, "record.vendor: is not text"),
        ({"due": "soon"}, "record.due: is not a date"),
        ({"at": "soon"}, "record.at: is not a time"),
        ({"status": "closed"}, "record.status: is none of the values"),
        ({"tags": "a"}, "record.tags: is not a list"),
        ({"tags": ["a", 5]}, "record.tags[1]: is not text"),
        ({"lines": [{"sku": "x"}]}, "record.lines[0].n: is missing"),
        ({"lines": [{"sku": "x", "n": 1}, {"sku": "y", "n": "z"}]}, "record.lines[1].n: is not a whole number"),
        ({"any": {"x": 1}}, "record.any: is an object"),
        ({"paid": "perhaps"}, "record.paid: is not true or false"),
    ],
)
def test_complaints(spark, change, complaint):
    got, wrong = read(spark, {**GOOD, **change})
    assert got is None and wrong == [complaint]


def test_missing_and_no_object(spark):
    assert sorted(read(spark, {})[1]) == sorted(f"record.{n}: is missing" for n in GOOD)
    for text in ("[1]", "7", "nothing", ""):
        assert read(spark, text) == (None, ["record: is not a JSON object"])
    df = spark.createDataFrame([(None,)], "j string")
    assert df.select(schemas.answered(F.col("j"), INVOICE).alias("a")).first().a.record is None


def test_checks_are_open_unless_strict(spark):
    row = {k: v for k, v in GOOD.items() if k not in ("paid", "at")} | {"extra": 1, "odd 'name'": 2}
    df = spark.createDataFrame([(json.dumps(row),)], "j string")
    assert df.select(schemas.checked(F.col("j"), INVOICE).alias("c")).first().c.asDict() == {"valid": True, "problems": []}
    strict = df.select(schemas.checked(F.col("j"), INVOICE, strict=True).alias("c")).first().c
    assert not strict.valid and strict.problems == ["record.extra: is not in the schema", "record.odd 'name': is not in the schema"]
    odd = schemas.record_schema({"odd 'name'": "integer", "a.b": "integer"})
    got = spark.createDataFrame([('{"odd \'name\'": 2, "a.b": 3}',)], "j string").select(schemas.answered(F.col("j"), odd).alias("a")).first().a
    assert got.problems == [] and got.record["odd 'name'"] == 2 and got.record["a.b"] == 3


def test_example_is_valid(spark):
    assert schemas.example(INVOICE) == schemas.example(INVOICE)
    got, wrong = read(spark, schemas.example(INVOICE))
    assert wrong == [] and got["status"] == "open" and got["vendor"] == "text"
    assert schemas.example({"type": "integer", "minimum": 2.5}) == 3 and schemas.example({"type": "string", "minLength": 6}) == "textxx"
    assert schemas.example({"type": ["null"]}) is None and schemas.example({"type": "array"}) == []

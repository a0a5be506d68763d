"""Tables from files: JSON lines, CSV cells, text lines, whole files, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import NUMBER
from ..functions.texts import html_text


def _spine(df: DataFrame) -> DataFrame:
    """Adds ``__source``: the file each row comes from."""
    return df.withColumn("__source", F.col("_metadata.file_path"))


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(text, __source): lines as they are, without line ends, byte-order marks and blank lines."""
    return clean_lines(spark.read.text(paths))


def clean_lines(df: DataFrame) -> DataFrame:
    """``lines`` of a table or stream of text files."""
    df = _spine(df)
    text = F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r$", "")
    return df.select(text.alias("text"), "__source").where(F.trim("text") != "")


def records(spark: SparkSession, paths: list[str], strict: bool = True) -> DataFrame:
    """(raw, data, __source): JSON lines with the object as a variant; text that is no object has none, or is an error."""
    df = lines(spark, paths).withColumnRenamed("text", "raw")
    data = F.try_parse_json("raw")
    is_object = F.coalesce(F.schema_of_variant(data).startswith("OBJECT"), F.lit(False))
    other = F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("raw", 1, 80))).cast("variant") if strict else F.lit(None).cast("variant")
    return df.select("raw", F.when(is_object, data).otherwise(other).alias("data"), "__source")


def typed_records(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON lines read straight into the columns of ``schema``; a malformed line is an error."""
    return spark.read.schema(schema).json(paths, mode="FAILFAST")


def cell(c: Column) -> Column:
    """A CSV cell as JSON text: a number if it spells one, else a string; empty stays empty."""
    return F.when(c.rlike(NUMBER), F.trim(c)).otherwise(F.to_json(F.array(F.coalesce(c, F.lit("")))).substr(F.lit(2), F.length(F.to_json(F.array(F.coalesce(c, F.lit(""))))) - 2))


def csv(spark: SparkSession, paths: list[str], sep: str | None = None) -> DataFrame:
    """CSV with a header, all cells text; tabs part ``.tsv`` files. Quoted cells may span lines; a ragged row is an error."""
    sep = sep or ("\t" if all(p.endswith(".tsv") for p in paths) else ",")
    df = spark.read.csv(paths, header=True, sep=sep, multiLine=True, mode="FAILFAST", inferSchema=False, escape='"')
    names = [c.strip() for c in df.columns]
    if "" in names or len(set(names)) < len(names):
        raise ValueError("header names must be unique and not empty")
    return df.toDF(*names)


def number_columns(df: DataFrame) -> DataFrame:
    """Text columns whose every value spells a number become numbers: integers if all of them do, else doubles."""
    integral = r"^\s*[+-]?\d+\s*$"
    tests = df.agg(*[F.count(F.when(~F.col(f"`{c}`").rlike(NUMBER), 1)).alias(f"n{i}") for i, c in enumerate(df.columns)], *[F.count(F.when(~F.col(f"`{c}`").rlike(integral), 1)).alias(f"i{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[(F.trim(F.col(f"`{c}`")).try_cast("bigint" if tests[f"i{i}"] == 0 else "double").alias(c) if tests[f"n{i}"] == 0 else F.col(f"`{c}`")) for i, c in enumerate(df.columns)])


def files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, kind, text, content): whole files; text files have their text, line ends made one, others their bytes."""
    df = spark.read.format("binaryFile").load(paths)
    head = F.hex(F.substring("content", 1, 4))
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = (
        F.when(ext.isin("txt", "md", "json", "jsonl", "csv", "tsv", "html", "htm", "log", "xml", "yaml", "yml"), "text")
        .when((ext == "pdf") | (head == "25504446"), "pdf").when(ext.isin("docx", "pptx", "xlsx", "epub"), "document")
        .when(ext.isin("png", "jpg", "jpeg", "gif", "webp") | head.isin("89504E47", "47494638") | head.startswith("FFD8FF"), "image")
        .when(ext.isin("mp3", "wav", "m4a", "flac", "ogg"), "audio").when(ext.isin("mp4", "mov", "mkv", "webm"), "video").otherwise("text")
    )
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^\ufeff|\r\n?", "\n")
    text = F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", F.substring(text, 2, 2**31 - 1)).otherwise(text)
    return df.select("path", kind.alias("kind"), F.when(kind == "text", text).alias("text"), F.when(kind != "text", F.col("content")).alias("content"))


def documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(text, __source, kind, unread): whole files as readable text, a row for each. Text files are decoded (what is no
    UTF-8 is replaced, line ends become one), HTML files give their readable text, other kinds have none and ``unread``
    true, so nothing aborts and the caller sees what was left out. Spark deals the files out by size."""
    df = files(spark, paths)
    is_html = F.lower("path").rlike(r"\.x?html?$")
    text = F.when(is_html, html_text(F.col("text"))).otherwise(F.col("text"))
    return df.select(text.alias("text"), F.col("path").alias("__source"), F.when(is_html, "html").otherwise(F.col("kind")).alias("kind"), F.col("text").isNull().alias("unread"))


def read(spark: SparkSession, paths: list[str], as_: str | None = None) -> DataFrame:
    """Paths as the table that their names call for, or as ``as_`` says: "lines" (text), "records" (JSON lines, any other
    line is an error), "csv", or "file" (whole documents). All paths must call for the same."""
    wanted = as_ or _called_for(paths)
    made = {"lines": lines, "records": records, "csv": csv, "file": documents}.get(wanted)
    if made is None:
        raise ValueError(f"files are read as lines, records, csv or file, not {wanted!r}")
    return made(spark, paths)


def _called_for(paths: list[str]) -> str:
    kinds = {"jsonl": "records", "ndjson": "records", "csv": "csv", "tsv": "csv"}
    found = {kinds.get(p.rsplit(".", 1)[-1].lower() if "." in p else "", "file") for p in paths}
    if len(found) != 1:
        raise ValueError(f"paths call for {', '.join(sorted(found)) or 'nothing'}: say which with as_")
    return found.pop()


def named_files(spark: SparkSession, names: DataFrame, column: str, limit: int = 100_000) -> DataFrame:
    """The files that a bounded table of names lists."""
    found = [r[0] for r in names.select(column).limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} names: read their folders instead")
    return files(spark, found)

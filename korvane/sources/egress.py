"""Exactly named files from rows: one file for each whole item, or the rows of a target in one file, in order.

A Python data source writes into a staging folder below the root; when all tasks have ended, the driver checks the names
and moves the files to their places. A job that fails leaves nothing behind, and neither do tasks that were lost.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.fields import field as field_of

#: Template fields that come from a row's source.
RESERVED = ("path", "name", "stem", "ext", "index")


def target_name(template: str, df: DataFrame, source: str = "__source", index: str | None = None) -> Column:
    """A template's value for each row. ``{path}``, ``{name}``, ``{stem}`` and ``{ext}`` are those of the file in the
    column ``source``, ``{index}`` is the column ``index`` plus 1; ``{field}`` is a column's text, or a path into one.
    ``{{`` and ``}}`` are braces. A row that lacks a value is an error that names the field."""
    name = F.regexp_extract(F.col(f"`{source}`"), r"([^/\\]*)$", 1) if source in df.columns else F.lit(None).cast("string")
    stem = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)
    ext = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"\.([^.]+)$", 1)).otherwise(F.when(name.isNotNull(), F.lit("")))
    known = {"path": F.col(f"`{source}`") if source in df.columns else name, "name": name, "stem": stem, "ext": ext}
    out = []
    for part in [p for p in re.split(r"(\{\{|\}\}|\{[^{}]*\})", template) if p]:
        if part in ("{{", "}}"):
            out.append(F.lit(part[0]))
        elif part[0] == "{" and part[-1] == "}":
            field = part[1:-1]
            if not field or field.isdigit():
                raise ValueError(f"{part} in {template!r} names no field; beside a row's fields there are {', '.join(RESERVED)}")
            if field == "index" and index is not None:
                value = (F.col(f"`{index}`") + 1).cast("string")
            elif field in known:
                value = known[field]
            else:
                value = field_of(df, field).cast("string")
            out.append(F.coalesce(value, F.raise_error(F.lit(f"a row has no {field!r} for the template {template!r}")).cast("string")))
        elif "{" in part or "}" in part:
            raise ValueError(f"a brace in {template!r} stands alone")
        else:
            out.append(F.lit(part))
    return F.concat(*out)


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: (target, staged file, whether it is one whole item)."""

    files: list[tuple[str, str, bool]]


def _inside(target: str) -> str:
    """The target as a relative path that stays below the root."""
    parts = [p for p in target.replace("\\", "/").split("/") if p not in ("", ".")]
    if not parts or ".." in parts or target.startswith("/"):
        raise ValueError(f"{target!r} is no file below the output folder")
    return "/".join(parts)


class EgressWriter(DataSourceArrowWriter):
    """Rows (target, content, whole) as files below ``root``."""

    def __init__(self, options: dict) -> None:
        self.root, self.overwrite = options["root"], options.get("replace", "false") == "true"
        self.staging = f"_staging-{options['job']}"

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        fs, path = pafs.FileSystem.from_uri(self.root)
        return fs, path.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, root = self._fs()
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"  # each attempt has its own
        fs.create_dir(folder)
        files: list[tuple[str, str, bool]] = []
        out = None
        try:
            for batch in iterator:
                for target, content, whole in zip(*(batch.column(c).to_pylist() for c in ("target", "content", "whole"))):
                    name = _inside(target)
                    if out is None or whole or files[-1][2] or files[-1][0] != name:
                        if out is not None:
                            out.close()
                        files.append((name, f"{folder}/{len(files)}", whole))
                        out = fs.open_output_stream(files[-1][1])
                    out.write(content or b"")
        finally:
            if out is not None:
                out.close()
        return Staged(files)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = self._fs()
        seen: dict[str, bool] = {}
        files = [f for m in messages if m is not None for f in m.files]
        for target, _, whole in files:
            if target in seen:
                self.abort(messages)
                raise ValueError(f"{target!r} is written twice; a template for whole items needs {{index}} or another field that tells them apart")
            seen[target] = whole
        if not self.overwrite:
            taken = [f.path for f in fs.get_file_info([f"{root}/{t}" for t in seen]) if f.type != pafs.FileType.NotFound]
            if taken:
                self.abort(messages)
                raise ValueError(f"{taken[0]!r} exists")
        for folder in {t.rpartition("/")[0] for t in seen}:
            fs.create_dir(f"{root}/{folder}", recursive=True)
        for target, staged, _ in files:
            fs.move(staged, f"{root}/{target}")
        fs.delete_dir(f"{root}/{self.staging}")

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = self._fs()
        if fs.get_file_info(f"{root}/{self.staging}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{self.staging}")


class Egress(DataSource):
    """The data source "egress": see ``write_items`` and ``write_lines``."""

    @classmethod
    def name(cls) -> str:
        return "egress"

    def schema(self) -> str:
        return "target string, content binary, whole boolean"

    def writer(self, schema, overwrite: bool) -> EgressWriter:
        return EgressWriter(self.options)


def _write(rows: DataFrame, root: str, replace: bool) -> None:
    spark = rows.sparkSession
    spark.dataSource.register(Egress)
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    rows.write.format("egress").option("root", root).option("job", uuid.uuid4().hex).option("replace", str(replace).lower()).mode("append").save()


def write_items(df: DataFrame, root: str, target: Column, content: Column, replace: bool = False) -> None:
    """One file below ``root`` for each row, named by ``target``, with exactly its ``content`` (text as UTF-8, or bytes;
    null is an empty file).

    Two rows of one name, a name outside ``root`` and, without ``replace``, a file that is there already are errors, and
    then no file appears. Rows stay where they are; the driver learns the files' names, some 100 bytes each. ``root`` is a
    folder that pyarrow can write to from every executor: a shared folder or an object store.
    """
    _write(df.select(target.alias("target"), content.cast("binary").alias("content"), F.lit(True).alias("whole")), root, replace)


def write_lines(df: DataFrame, root: str, target: Column, value: Column, order: list[str], replace: bool = False) -> None:
    """The rows of each ``target`` as lines of one file, in the order of ``order``; null values are empty lines.

    A target's rows are sorted and written as a stream by one task, since they are one file; names with many rows should
    be split by the template. For the rest as ``write_items``.
    """
    line = F.concat(F.coalesce(value.cast("string"), F.lit("")), F.lit("\n")).cast("binary")
    rows = df.select(target.alias("target"), line.alias("content"), F.lit(False).alias("whole"), *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)])
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "target").sortWithinPartitions("target", *[f"_o{i}" for i in range(len(order))])
    _write(rows.select("target", "content", "whole"), root, replace)

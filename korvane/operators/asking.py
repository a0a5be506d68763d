"""Requests to models at scale: a durable table of answers, budgets of distinct requests, inputs beyond a model's window,
and a bounded number of requests under way."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.texts import chunks_of, tokens_of
from ..shared import materialize, pieces, small, with_columns
from .semantic import ChatModel, ask, validated

#: How often a chunk that a model finds too long is halved.
MAX_HALVINGS = 3


class Overflow(Exception):
    """What a model raises for a prompt beyond its window."""


# Answers that outlive a run


@dataclass
class AnswerCache:
    """A folder of Parquet files with an answer for each request that was ever answered, found by the request's digest.
    Rows are only added, so runs may share it; of two answers to one request the lesser counts."""

    spark: SparkSession
    path: str

    SCHEMA = "digest string, answer string"

    def table(self) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def add(self, answers: DataFrame) -> None:
        answers.select("digest", "answer").where("answer is not null").write.mode("append").parquet(self.path)


def request_digest(question: Column, model_name: str) -> Column:
    """SHA-256 of model and question: equal requests share it, whichever rows or runs they come from."""
    return F.sha2(F.concat(F.lit(f"{model_name}\0"), question), 256)


def ask_cached(df: DataFrame, question: Column, model: ChatModel, cache: AnswerCache, model_name: str, into: str = "_answer", max_calls: int | None = None, order: str | None = None, waves: int = 1) -> tuple[DataFrame, DataFrame]:
    """``df`` with the model's answer to each row's question, and what that took: one row (requests, distinct, hits,
    asked, unanswered).

    Equal questions of the whole table are one request; those that the cache knows are not asked again, and new answers
    are added to it in ``waves``, so a run that ends early leaves what its waves have found. ``max_calls`` bounds the
    distinct requests that are sent, those first by ``order`` (a column; else by digest): rows beyond it, rows without a
    question and requests that fail have no answer, and are not kept.
    """
    asked_of = df.withColumn("_digest", request_digest(question, model_name))
    first = F.min(F.col(f"`{order}`") if order else F.col("_digest"))
    distinct = asked_of.where("_digest is not null").withColumn("_request", question).groupBy(F.col("_digest").alias("digest")).agg(F.min("_request").alias("_request"), first.alias("_first"), F.count(F.lit(1)).alias("_rows"))
    distinct = materialize(distinct, "ask-requests")
    misses = distinct.join(cache.table().select("digest"), "digest", "left_anti")
    if max_calls is not None:
        misses = misses.orderBy("_first", "digest").limit(max_calls)
    misses = materialize(misses.select("digest", "_request"), "ask-misses")
    counts = distinct.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("requests"), F.count(F.lit(1)).alias("distinct"))
    hits = distinct.join(cache.table().select("digest"), "digest", "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    usage = materialize(counts.crossJoin(hits).crossJoin(misses.agg(F.count(F.lit(1)).alias("asked"))), "ask-usage")  # one row each
    for wave in range(waves):
        cache.add(ask(misses.where(F.pmod(F.xxhash64("digest"), F.lit(waves)) == wave), F.col("_request"), model, "answer"))
    known = cache.table().join(distinct.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min("answer").alias(into))
    known = materialize(known.withColumnRenamed("digest", "_known"), "ask-known")
    out = asked_of.join(small(known), F.col("_digest") == F.col("_known"), "left").drop("_digest", "_known")
    answered = distinct.join(known, F.col("digest") == F.col("_known"), "left_semi").agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("answered"))
    return out, usage.crossJoin(answered).select("requests", "distinct", "hits", "asked", (F.col("requests") - F.col("answered")).alias("unanswered"))


# Requests under way


@dataclass
class Pooled(ChatModel):
    """Sends prompts on their own, ``width`` at a time, and gives answers in order. After ``breaks`` failures in a row the
    model counts as broken: from then on, and for the prompts that failed in that row, the second model is asked. A prompt
    that fails otherwise goes to the second model alone; without one, or if that fails too, it has no answer."""

    model: ChatModel
    width: int = 8
    second: ChatModel | None = None
    breaks: int = 5
    broken: bool = False
    row: int = 0

    def complete(self, prompts: list[str]) -> list[str | None]:
        answers: list[str | None] = [None] * len(prompts)
        held: list[int] = []  # failed on the first model

        def take(i: int, sent: Future) -> None:
            try:
                answers[i], self.row = sent.result(), 0
            except Exception:  # whatever a provider raises
                held.append(i)
                self.row += 1
                self.broken = self.broken or self.row >= self.breaks

        with ThreadPoolExecutor(self.width) as pool:
            window: list[tuple[int, Future]] = []  # in order; no more than ``width`` are under way
            for i, p in enumerate(prompts):
                if self.broken:
                    held.append(i)
                    continue
                if len(window) == self.width:
                    take(*window.pop(0))
                window.append((i, pool.submit(lambda p: self.model.complete([p])[0], p)))
            for w in window:
                take(*w)
            if self.second is not None:
                for i, sent in [(i, pool.submit(lambda p: self.second.complete([p])[0], prompts[i])) for i in sorted(held)]:
                    try:
                        answers[i] = sent.result()
                    except Exception:  # no answer then
                        answers[i] = None
        return answers


# Inputs beyond a model's window


@dataclass
class Long:
    """One row's questions: its chunks, each asked until one is answered yes (``first``) or all are answered."""

    chunks: list[str]
    answers: list[str | None] = field(default_factory=list)
    at: int = 0
    depth: int = 0


def _halves(chunk: str) -> list[str]:
    return chunks_of(chunk, max(1, tokens_of(chunk) // 2))


def answer_chunk(model: ChatModel, fill: Callable[[str], str], chunk: str, done: Callable[[str | None], bool] = lambda a: False, depth: int = MAX_HALVINGS) -> list[str | None]:
    """The answers to a chunk: one, or those of its halves if the model finds it too long, down to ``depth`` halvings;
    what cannot be halved further has no answer (None). Stops after the first answer that is ``done``."""
    try:
        return model.complete([fill(chunk)])
    except Overflow:
        halves = _halves(chunk) if depth else []
        out: list[str | None] = []
        for half in halves if len(halves) > 1 else []:
            out += answer_chunk(model, fill, half, done, depth - 1)
            if out and done(out[-1]):
                break
        return out or [None]


def _asked(model: ChatModel, prompts: list[tuple[Callable[[str], str], str]], done: Callable[[str | None], bool]) -> list[list[str | None]]:
    """Answers to chunks of different rows: all at once, and one by one if that is too long for the model."""
    try:
        return [[a] for a in model.complete([fill(chunk) for fill, chunk in prompts])]
    except Overflow:
        return [answer_chunk(model, fill, chunk, done) for fill, chunk in prompts]


YES = r'^\s*(yes|true)\b|"match"\s*:\s*true'


def _filled(template: str, values: dict, chunked: str) -> Callable[[str], str]:
    """The template with a row's values; the field ``chunked`` is left open."""
    import re

    parts = re.split(r"(\{\{|\}\}|\{\w+\})", template)
    plain = [{"{{": "{", "}}": "}"}.get(p, p) if not re.fullmatch(r"\{\w+\}", p) else None if p[1:-1] == chunked else "" if values[p[1:-1]] is None else str(values[p[1:-1]]) for p in parts]
    return lambda chunk: "".join(chunk if p is None else p for p in plain)


def _first(value: str | None) -> bool:
    import re

    return value is not None and re.search(YES, value, re.I) is not None


def _in_turns(part: pa.RecordBatch, text: str, template: str, model: ChatModel, budget: int, early: bool) -> tuple[list[list[str | None]], list[int]]:
    """Each row's answers by chunk, and how many chunks were asked. Rows of a batch take turns: all first chunks are one
    call, then the second ones of the rows that are undecided, and so on."""
    done = _first if early else lambda a: False
    named = [c for c in part.schema.names if f"{{{c}}}" in template and c != text]
    values = [dict(zip(named, row)) for row in zip(*(part.column(c).to_pylist() for c in named))] if named else [{}] * len(part)
    fills = [_filled(template, row, text) for row in values]
    chunks = [(chunks_of(t, budget) or [""]) if t is not None else [] for t in part.column(text).to_pylist()]
    answers: list[list[str | None]] = [[] for _ in chunks]
    asked = [0] * len(chunks)
    going = [i for i, c in enumerate(chunks) if c]
    while going:
        for i, got in zip(going, _asked(model, [(fills[i], chunks[i][asked[i]]) for i in going], done)):
            answers[i] += got
            asked[i] += 1
        going = [i for i in going if asked[i] < len(chunks[i]) and not done(answers[i][-1])]
    return answers, asked


def judge_long(df: DataFrame, text: str, template: str, model: ChatModel, budget: int) -> DataFrame:
    """``df`` with _match and _asked: whether the model answers yes for any chunk of the column ``text``, and how many
    chunks it was asked about. ``{field}`` in the template is a column; that of ``text`` is a chunk of about ``budget``
    tokens. Chunks are asked in order and not beyond the first yes; a chunk that the model finds too long is halved, at
    most MAX_HALVINGS times. No answer at all is null, as is a row without text, which is not asked.

    Works on rows of documents as on candidate pairs of a join, where a side is long.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("_match", T.BooleanType()), T.StructField("_asked", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text):
            answers, asked = _in_turns(part, text, template, model, budget, True)
            match = [True if any(map(_first, a)) else None if all(x is None for x in a) else False for a in answers]
            yield with_columns(part, schema.names, pa.array(match, pa.bool_()), pa.array(asked, pa.int64()))

    return df.mapInArrow(run, schema)


def map_long(df: DataFrame, text: str, template: str, merge_template: str, model: ChatModel, budget: int, schema: str | dict | None = None, keep_invalid: bool = False) -> DataFrame:
    """``df`` with the model's answer to its whole column ``text``: as ``result``, or as validated fields of ``schema``.

    A text within ``budget`` tokens is asked as it is. A longer one is asked chunk by chunk, and the answers (``{items}``
    in ``merge_template``, one a line) are merged by one more question; while they exceed the budget together, runs of
    them that fit are merged first. Rows without text have no answer. With a schema, invalid answers go unless
    ``keep_invalid``.
    """
    wide = T.StructType([*df.schema.fields, T.StructField("_answer", T.StringType())])

    def merged(notes: list[str]) -> str | None:
        while len(notes) > 1 and sum(map(tokens_of, notes)) > budget:
            runs, used = [[notes[0]]], tokens_of(notes[0])
            for n in notes[1:]:
                used += tokens_of(n)
                if used > budget:
                    runs.append([])
                    used = tokens_of(n)
                runs[-1].append(n)
            if len(runs) == len(notes):
                break  # no two fit: one question for all then
            notes = [r[0] if len(r) == 1 else model.complete([merge_template.replace("{items}", "\n".join(r))])[0] or "" for r in runs]
        return model.complete([merge_template.replace("{items}", "\n".join(notes))])[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text):
            answers, _ = _in_turns(part, text, template, model, budget, False)
            out = []
            for found in answers:
                notes = [a.strip() for a in found if a is not None]
                out.append(None if not notes else notes[0] if len(found) == 1 else merged(notes))
            yield with_columns(part, wide.names, pa.array(out, pa.string()))

    answered = df.mapInArrow(run, wide)
    if schema is None:
        return answered.withColumnRenamed("_answer", "result")
    out = validated(answered, schema)
    taken = set(out.schema["_record"].dataType.names)
    kept = [F.col(f"`{c}`") for c in df.columns if c not in taken]
    return out.select(*kept, "_record.*", "__invalid", "__error", "__raw") if keep_invalid else out.where("not __invalid").select(*kept, "_record.*")


def usage_text(usage: DataFrame) -> str:
    """The one row of a usage table as JSON."""
    return json.dumps(usage.first().asDict())

"""Operators that ask a model: embed, map, extend, filter, judge pairs, reduce. Providers are plug-ins; the offline ones
are deterministic, so the same row gives the same answer however rows are dealt out."""

from __future__ import annotations

import hashlib
import json
import re
import time
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fields, schemas
from ..functions.texts import chunks_of, repaired
from ..shared import materialize, pieces, small, with_columns

#: Texts of one request to an embedding model.
BATCH = 64
#: What a model that names a cluster sees of it: so many texts of so many characters.
LABEL_TEXTS, LABEL_WIDTH = 8, 200


class ChatModel(ABC):
    """Answers prompts; called inside tasks, so it must pickle."""

    @abstractmethod
    def complete(self, prompts: list[str]) -> list[str]:
        """An answer for each prompt."""


class EmbeddingModel(ABC):
    name: str

    @abstractmethod
    def embed(self, texts: list[str]) -> list[list[float]]:
        """A vector for each text."""


@dataclass
class RuleChat(ChatModel):
    """A chat model for tests and offline use: a function from prompt to answer."""

    rule: Callable[[str], str]

    def complete(self, prompts: list[str]) -> list[str]:
        return [self.rule(p) for p in prompts]


@dataclass
class HashingEmbedder(EmbeddingModel):
    """Bags of words hashed to signed places; unit length."""

    size: int = 64
    name: str = "hashing-64"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.size)
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


@dataclass
class WithFallback(ChatModel):
    """Asks the second model what the first fails at."""

    first: ChatModel
    second: ChatModel

    def complete(self, prompts: list[str]) -> list[str]:
        try:
            return self.first.complete(prompts)
        except Exception:  # whatever a provider raises, the other one is asked
            return self.second.complete(prompts)


@dataclass
class Guarded(ChatModel):
    """Asks again, one by one, what failed together; a prompt that fails alone has no answer (null). The job halts after
    ``in_row`` failures in a row, or once over half of ``least`` or more prompts have failed. Each task counts its own."""

    model: ChatModel
    in_row: int = 5
    least: int = 20
    seen: int = 0
    failed: int = 0
    row: int = 0

    def complete(self, prompts: list[str]) -> list[str]:
        try:
            out = self.model.complete(prompts)
        except Exception:  # whatever a provider raises
            return [self._one(p) for p in prompts]
        self.seen, self.row = self.seen + len(prompts), 0
        return out

    def _one(self, prompt: str) -> str | None:
        self.seen += 1
        try:
            out = self.model.complete([prompt])[0]
        except Exception as why:
            self.failed, self.row = self.failed + 1, self.row + 1
            if self.row >= self.in_row or (self.seen >= self.least and 2 * self.failed > self.seen):
                raise RuntimeError(f"{self.failed} of {self.seen} prompts failed") from why
            return None
        self.row = 0
        return out


def embed(df: DataFrame, text: str, model: EmbeddingModel, into: str = "vector", budget: int | None = None) -> DataFrame:
    """``df`` with a vector of each text and the model's name as ``__embedder``. Texts over ``budget`` tokens are
    embedded in chunks whose mean counts. Null text has no vector."""
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.DoubleType())), T.StructField("__embedder", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, text):
            parts = [(i, c) for i, t in enumerate(part.column(text).to_pylist()) if t is not None for c in (chunks_of(t, budget) if budget else [t]) or [t]]
            vectors = [v for a in range(0, len(parts), BATCH) for v in model.embed([c for _, c in parts[a : a + BATCH]])]
            own: dict[int, list] = {}
            for (i, _), v in zip(parts, vectors):
                own.setdefault(i, []).append(v)
            means = [np.mean(own[i], axis=0).tolist() if i in own else None for i in range(len(part))]
            yield with_columns(part, schema.names, pa.array(means, pa.list_(pa.float64())), pa.array([model.name] * len(part), pa.string()))

    return df.mapInArrow(run, schema)


def with_vectors(df: DataFrame, text: str, model: EmbeddingModel, into: str = "vector", size: int | None = None) -> DataFrame:
    """``embed`` that keeps the vectors that rows bring along in the column ``into``: only rows without one are embedded.

    A vector whose ``__embedder`` stamp names another model, or whose length is not ``size`` (if given), is an error once
    the row is read; vectors without a stamp are taken as they are, and so stamped. Nothing is counted first.
    """
    if into not in df.columns:
        return embed(df, text, model, into)
    stamp = F.col("__embedder").cast("string") if "__embedder" in df.columns else F.lit(None).cast("string")
    old = F.col(f"`{into}`").cast("array<double>")
    wrong = F.when(old.isNotNull() & (stamp != model.name), F.concat(F.lit("a vector of "), stamp, F.lit(f" does not mix with those of {model.name}")))
    if size is not None:
        wrong = F.coalesce(wrong, F.when(old.isNotNull() & (F.size(old) != size), F.concat(F.lit("a vector of "), F.size(old).cast("string"), F.lit(f" components among those of {size}"))))
    checked = F.when(wrong.isNotNull(), F.raise_error(wrong).cast("array<double>")).otherwise(old)
    rest = [c for c in df.columns if c not in (into, "__embedder")]
    asked = F.when(F.col(f"`{into}`").isNull(), F.col(f"`{text}`"))
    made = embed(df.select(*[F.col(f"`{c}`") for c in rest], checked.alias("_old"), asked.alias("_embed")), "_embed", model, into)
    return made.select(*[F.col(f"`{c}`") for c in rest], F.coalesce(F.col("_old"), F.col(f"`{into}`")).alias(into), "__embedder")


def prompt(template: str, df: DataFrame) -> Column:
    """A prompt from a template: ``{field}`` is a column's text, or a path into one (``{user.name}``, ``{items[0].sku}``);
    lists and structs are their JSON, missing values nothing. ``{{`` and ``}}`` are braces. A name that the table does not
    have is an error."""
    out = []
    for part in filter(None, re.split(r"(\{\{|\}\}|\{[^{}\s][^{}]*\})", template)):
        if part in ("{{", "}}"):
            out.append(F.lit(part[0]))
        elif part[0] == "{" and part[-1] == "}" and len(part) > 2:
            path = part[1:-1]
            if path not in df.columns and str(fields.hops(path)[0]) not in df.columns:
                raise ValueError(f"the prompt names {path!r}; there are {', '.join(df.columns)}")
            out.append(F.coalesce(_as_text(fields.field(df, path), df), F.lit("")))
        else:
            out.append(F.lit(part))
    return F.concat(*out)


def _as_text(c: Column, df: DataFrame) -> Column:
    kind = df.select(c.alias("c")).schema["c"].dataType
    return F.to_json(c) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else c.cast("string")


def payload(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as a block that prompts hold: ``<input>``, a line "field: value" for each value that is there, ``</input>``.
    Columns that begin with two underscores stay out unless named. Values are escaped as in XML, so none of them can end
    the block; further lines of a value are indented. A table of one column ``text`` is its plain text."""
    names = columns or [c for c in df.columns if not c.startswith("__")]
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    if names == ["text"]:
        body = escaped(F.col("text"))
    else:
        body = F.concat_ws("\n", *[F.concat(F.lit(f"{n}: "), F.regexp_replace(escaped(_as_text(F.col(f"`{n}`"), df)), "\r?\n", "\n  ")) for n in names])
    return F.concat(F.lit("<input>\n"), F.coalesce(body, F.lit("")), F.lit("\n</input>"))


def ask(df: DataFrame, question: Column, model: ChatModel, into: str = "_answer") -> DataFrame:
    """``df`` with the model's answer to each row's question. Equal questions of a piece of a batch are asked once; a
    worker holds no more than such a piece as objects, however many rows there are."""
    wide = df.withColumn("_question", question)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "_question"):
            questions = part.column("_question").to_pylist()
            distinct = list(dict.fromkeys(questions))
            answers = dict(zip(distinct, model.complete(distinct)))
            yield with_columns(part, schema.names, pa.array([answers[q] for q in questions], pa.string()))

    return wide.mapInArrow(run, schema)


def capped(df: DataFrame, order: str, max_calls: int) -> DataFrame:
    """The rows that a budget of ``max_calls`` covers, first by ``order``."""
    return df.orderBy(order).limit(max_calls)


def mended(text: Column) -> Column:
    """The JSON object or array that an answer holds, with the usual slips mended."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: repaired(t) if t is not None else None)

    return run(text)


def validated(answers: DataFrame, schema: str | schemas.Schema, into: str = "_answer") -> DataFrame:
    """The answer as a struct ``_record``, mended and coerced; what fails has ``__invalid`` true, an ``__error`` and the
    answer as ``__raw``.

    ``schema`` is columns as in SQL, of which a valid answer has one at least, or a record schema (``functions.schemas``),
    with which a valid answer agrees in full.
    """
    out = answers.withColumn("_json", mended(F.col(into)))
    if isinstance(schema, str):
        fields_ = T.StructType.fromDDL(schema).names
        out = out.withColumn("_record", F.from_json("_json", schema, {"mode": "PERMISSIVE"}))
        bad = F.col("_record").isNull() | ~F.exists(F.array(*[F.col("_record").getField(f).isNotNull() for f in fields_]), lambda x: x)
        error = F.lit("no field of the schema")
    else:
        out = out.withColumn("_read", schemas.answered(F.col("_json"), schema)).withColumn("_record", F.col("_read.record"))
        bad, error = F.size("_read.problems") > 0, F.array_join("_read.problems", "; ")
    bad = F.col("_json").isNull() | bad
    out = out.withColumn("__invalid", bad).withColumn("__error", F.when(bad, F.when(F.col("_json").isNull(), "no JSON in the answer").otherwise(error))).withColumn("__raw", F.when(bad, F.col(into)))
    return out.drop("_json", "_read", into)


def map_rows(df: DataFrame, template: str, model: ChatModel, schema: str | schemas.Schema | None = None, keep_invalid: bool = False) -> DataFrame:
    """The model's answers instead of the rows: a text ``result``, or the validated fields of ``schema``."""
    answers = ask(df, prompt(template, df), model)
    if schema is None:
        return answers.select(F.col("_answer").alias("result"))
    out = validated(answers, schema)
    return out.select("_record.*", "__invalid", "__error", "__raw") if keep_invalid else out.where("not __invalid").select("_record.*")


def extend_rows(df: DataFrame, template: str, model: ChatModel, schema: str | schemas.Schema) -> DataFrame:
    """The rows with the validated fields of ``schema`` added; fields of the same name are replaced. Rows whose answer is
    invalid keep their old fields; where old and new values are of different types, both are text then."""
    out = validated(ask(df, prompt(template, df), model), schema)
    new = {f.name: f.dataType for f in out.schema["_record"].dataType.fields}

    def merged(f: str, kind: T.DataType) -> Column:
        answer = F.col("_record").getField(f)
        if f not in df.columns:
            return F.when(~F.col("__invalid"), answer)
        old = F.col(f"`{f}`")
        if df.schema[f].dataType == kind:
            return F.when(F.col("__invalid"), old).otherwise(answer)
        return F.when(F.col("__invalid"), _as_text(old, df)).otherwise(F.to_json(answer) if isinstance(kind, (T.ArrayType, T.StructType)) else answer.cast("string"))

    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in new], *[merged(f, kind).alias(f) for f, kind in new.items()])


def filter_rows(df: DataFrame, template: str, model: ChatModel, invert: bool = False) -> DataFrame:
    """The rows that the model answers yes to (yes, true, or a record with a true ``match``), or with ``invert`` those that
    it doesn't. A row without an answer goes neither way."""
    yes = F.lower(F.trim(F.col("_answer"))).rlike(r'^(yes|true)\b|"match"\s*:\s*true')
    out = ask(df, prompt(template, df), model)
    return out.where(~yes if invert else yes).drop("_answer")


def filter_long(df: DataFrame, key: str, text: str, template: str, model: ChatModel, budget: int) -> DataFrame:
    """``filter_rows`` for texts over the model's budget: a row stays if any chunk (``{chunk}``) is answered yes."""
    from ..functions.texts import chunks

    parts = df.select(key, F.explode(chunks(F.col(text), budget)).alias("chunk"))
    return df.join(filter_rows(parts, template, model).select(key).distinct(), key, "left_semi")


def label_clusters(examples: DataFrame, model: ChatModel | None = None) -> DataFrame:
    """(cluster, label) from ``vectors.cluster_examples``: the model's name for a cluster, "cluster N" if it has none. The
    model sees LABEL_TEXTS examples at most, the nearest ones, each LABEL_WIDTH characters long at most."""
    lists = F.array_sort(F.collect_list(F.struct("rank", F.substring("example", 1, LABEL_WIDTH).alias("t"))))
    seen = examples.where(F.col("rank") <= LABEL_TEXTS).groupBy("cluster").agg(F.array_join(F.transform(lists, lambda x: x["t"]), "\n").alias("texts"))
    plain = F.concat(F.lit("cluster "), F.col("cluster").cast("string"))
    if model is None:
        return seen.select("cluster", plain.alias("label"))
    named = ask(seen, prompt("Name what these texts have in common in a few words.\n{texts}", seen), model)
    return named.select("cluster", F.coalesce(F.when(F.trim("_answer") != "", F.trim("_answer")), plain).alias("label"))


def judged_pairs(pairs: DataFrame, template: str, model: ChatModel) -> DataFrame:
    """Candidate pairs (of a similarity join) that the model confirms."""
    return filter_rows(pairs, template, model)


def reduce_rows(df: DataFrame, text: str, order: str, template: str, model: ChatModel, by: list[str] = (), fan_in: int = 20) -> DataFrame:
    """One answer (``result``) for each group, rows with a missing key left out, through a tree: ``fan_in`` texts in order make one answer, answers make
    the next, until one is left. No task gets more than ``fan_in`` texts at a time, however large a group is."""
    from .rows import numbered

    keys = list(by)
    keyed = df.where(F.col(text).isNotNull()).dropna(subset=keys) if keys else df.where(F.col(text).isNotNull())
    level = numbered(keyed.select(*keys, F.col(order).alias("_o"), F.col(text).alias("_t")), [*keys, "_o"])
    level = materialize(level, "reduce-rows")
    starts = materialize(level.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_n").alias("_start")), "reduce-starts")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    level = level.join(small(starts), same).select(*keys, (F.col("_n") - F.col("_start")).alias("_p"), "_t")
    level = materialize(level, "reduce")
    first = True
    while first or level.groupBy(*keys).count().where("count > 1").limit(1).count():
        joined = level.groupBy(*keys, F.floor(F.col("_p") / fan_in).alias("_p")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda x: x["_t"]), "\n").alias("items"))
        answered = ask(joined, prompt(template, joined), model)
        level, first = materialize(answered.select(*keys, "_p", F.col("_answer").alias("_t")), "reduce"), False
    return level.select(*keys, F.col("_t").alias("result"))


def check_records(df: DataFrame, rules: dict[str, Column], fields: list[str]) -> DataFrame:
    """(field, rows, present, valid): how many rows have a field, and on how many its rule holds (absent counts as
    valid only if the rule says so)."""
    once = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.col(f"`{f}`")).alias(f"p{i}") for i, f in enumerate(fields)], *[F.count(F.when(F.coalesce(rules.get(f, F.lit(True)), F.lit(False)), 1)).alias(f"v{i}") for i, f in enumerate(fields)])
    row = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"p{i}").alias("present"), F.col(f"v{i}").alias("valid")) for i, f in enumerate(fields)])
    return once.select("rows", F.explode(row).alias("r")).select("r.field", "rows", "r.present", "r.valid")


def manifest(verb: str, options: dict, rows_in: int, rows_out: int, prompt: str | None = None, models: dict[str, str] | None = None, usage: dict[str, int] | None = None, seconds: float | None = None) -> str:
    """What a run did, as JSON; the digests of options and prompt tell whether two runs asked the same."""
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    said = {"verb": verb, "options": options, "options_sha256": digest(json.dumps(options, sort_keys=True, default=str)), "rows_in": rows_in, "rows_out": rows_out}
    said |= {"prompt": prompt, "prompt_sha256": digest(prompt)} if prompt is not None else {}
    said |= {k: v for k, v in (("models", models), ("usage", usage), ("seconds", seconds)) if v is not None}
    return json.dumps(said, default=str)


def recorded(verb: str, options: dict, df: DataFrame, apply: Callable[[DataFrame], DataFrame], out: str, record: str, prompt: str | None = None, models: dict[str, str] | None = None) -> dict:
    """Write ``apply(df)`` as Parquet below ``out``, and what the run did as one line of JSON below ``record``, which it
    also returns. Rows in and out are counted by the write itself."""
    began = time.monotonic()
    seen, made = Observation(f"{record}-in"), Observation(f"{record}-out")
    rows = apply(df.observe(seen, F.count(F.lit(1)).alias("n"))).observe(made, F.count(F.lit(1)).alias("n"))
    rows.write.parquet(out)
    line = manifest(verb, options, seen.get["n"], made.get["n"], prompt, models, seconds=round(time.monotonic() - began, 3))
    df.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.text(record)
    return json.loads(line)

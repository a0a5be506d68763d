"""Pipelines of verbs written down as TOML: stages in order, each a verb with its options and an input.

    [stage.hot]
    verb = "compare"
    field = "value"
    op = ">"
    to = 50

    [stage.count]
    verb = "summarize"
    input = "hot"
    aggs = [["count", ""]]
    by = ["event_type"]

A stage is a function call on DataFrames, so Spark plans the whole; a stage without ``input`` takes the one before it.
Verbs of two tables take the second as ``right``. Both name an earlier stage, or "input" for the pipeline's own input.
Verbs that ask a model name it as ``model``; the caller hands models over by name. Record schemas are tables of TOML.
"""

from __future__ import annotations

import inspect
import tomllib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fields, predicates
from ..functions.schemas import Schema, record_schema
from ..operators import asking, graph, reducing, rows, semantic, tables, vectors

Verb = Callable[..., DataFrame]
Model = semantic.ChatModel | semantic.EmbeddingModel
#: The name of the pipeline's own input.
INPUT = "input"


def _kind(df: DataFrame, field: str) -> str:
    t = df.schema[field].dataType
    return "string" if isinstance(t, T.StringType) else "boolean" if isinstance(t, T.BooleanType) else "time" if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "number"


def _schema(fields: str | dict | None) -> str | Schema | None:
    """Columns as in SQL, or a record schema from its fields: a type's name, a property, or "any"."""
    return record_schema({n: None if p == "any" else p for n, p in fields.items()}) if isinstance(fields, dict) else fields


VERBS: dict[str, Verb] = {
    "compare": lambda df, field, op, to: df.where(predicates.compare(F.col(field), op, to, _kind(df, field))),
    "has": lambda df, field, word: df.where(predicates.has(F.col(field), word)),
    "contains": lambda df, field, part: df.where(predicates.contains(F.col(field), part)),
    "matches": lambda df, field, pattern: df.where(predicates.matches(F.col(field), pattern)),
    "summarize": lambda df, aggs, by=(), bins=None: tables.summarize(df, [(a, f or None) for a, f in aggs], by, bins),
    "tally": lambda df, field, top=20: tables.tally(df, field, top),
    "sort": lambda df, by, desc=False, order=(): rows.sort_by(df, by, desc, list(order)),
    "sample": lambda df, n, order, seed=0: rows.sample(df, n, order, seed),
    "sample_by": lambda df, n, by, order, seed=0: rows.sample_by(df, n, by, order, seed),
    "distinct": lambda df, order, on=None: rows.distinct_exact(df, order, on),
    "explode": lambda df, field: rows.explode_field(df, field),
    "fields": lambda df, fields_: fields.project(df, fields_),
    "bare": lambda df: fields.bare(df),
    "schema": lambda df: tables.schema_profile(df),
    "by_time": lambda df, field, width: tables.by_time(df, field, width, _kind(df, field)),
    "facets": lambda df, fields_, top=20: tables.facets(df, fields_, top),
    "windows": lambda df, order, size, every=None: rows.count_windows(df, list(order), size, every),
    "join": lambda df, right, on, kind="inner": rows.join_on(df, right, [tuple(pair) for pair in on], kind),
    "union": lambda df, right: rows.union_all([df, right]),
    "agree": lambda df, right, on, label="label": tables.agreement(df, right, on, label),
    "top_k": lambda df, vector, near, k, order, threshold=None: vectors.top_k(df, vector, near, k, order, threshold),
    "similar": lambda df, right, k, left_id, right_id, vector, threshold=None, block_on=(): vectors.similarity_join(df, right, k, left_id, right_id, vector, threshold, block_on),
    "distinct_near": lambda df, order, vector, threshold=0.9: vectors.distinct_near(df, order, vector, threshold),
    "cluster": lambda df, order, vector, threshold=None, k=None: vectors.cluster(df, order, vector, threshold, k),
    "diff": lambda df, right, order, vector: vectors.diff(df, right, order, vector),
    "outliers": lambda df, order, vector, n=5: vectors.outliers(df, order, vector, n),
    "embed": lambda df, text, model, into="vector", budget=None: semantic.embed(df, text, model, into, budget),
    "vectors": lambda df, text, model, into="vector", size=None: semantic.with_vectors(df, text, model, into, size),
    "split": lambda df, text, budget=2000, source=None: rows.split_rows(df, text, budget, source),
    "map": lambda df, prompt, model, schema=None, keep_invalid=False: semantic.map_rows(df, prompt, model, _schema(schema), keep_invalid),
    "extend": lambda df, prompt, model, schema: semantic.extend_rows(df, prompt, model, _schema(schema)),
    "filter": lambda df, prompt, model, invert=False: semantic.filter_rows(df, prompt, model, invert),
    "judge": lambda df, text, prompt, model, budget: asking.judge_long(df, text, prompt, model, budget),
    "map_long": lambda df, text, prompt, merge, model, budget, schema=None, keep_invalid=False: asking.map_long(df, text, prompt, merge, model, budget, _schema(schema), keep_invalid),
    "reduce": lambda df, text, order, prompt, model, budget, final=None, by=(): reducing.reduce_packed(df, text, order, prompt, final or prompt, model, budget, list(by)),
    "edges": lambda df, source, target, relation=None, weight=None: graph.adopt(df, source, target, relation, weight),
}


def register(name: str, verb: Verb) -> None:
    """A verb of one's own; built-in names stay as they are."""
    VERBS.setdefault(name, verb)


def stages(text: str) -> list[tuple[str, str, str | None, dict]]:
    """(name, verb, input, options) of each stage; unknown verbs, inputs and options are errors that name them, and so
    are options that a verb needs and does not get."""
    out: list[tuple[str, str, str | None, dict]] = []
    for name, options in tomllib.loads(text).get("stage", {}).items():
        options = dict(options)
        if "verb" not in options:
            raise ValueError(f"stage {name}: no verb")
        verb, source = options.pop("verb"), options.pop("input", out[-1][0] if out else None)
        if verb not in VERBS:
            raise ValueError(f"stage {name}: no verb {verb!r}; there are {', '.join(sorted(VERBS))}")
        known = dict(list(inspect.signature(VERBS[verb]).parameters.items())[1:])
        if not any(p.kind is p.VAR_KEYWORD for p in known.values()):
            for o in options:
                if o not in known:
                    raise ValueError(f"stage {name}: {verb} has no option {o!r}; it has {', '.join(known) or 'none'}")
        for o, p in known.items():
            if p.default is p.empty and p.kind in (p.POSITIONAL_OR_KEYWORD, p.KEYWORD_ONLY) and o not in options:
                raise ValueError(f"stage {name}: {verb} needs {o!r}")
        for other in filter(None, (source, options.get("right"))):
            if other not in (INPUT, *(s[0] for s in out)):
                raise ValueError(f"stage {name}: no earlier stage {other!r}")
        out.append((name, verb, source, options))
    return out


def run(text: str, df: DataFrame, models: dict[str, Model] | None = None) -> DataFrame:
    """The last stage's result. ``models`` are those that stages name."""
    made = {INPUT: df}
    last = df
    planned = stages(text)
    for name, _, _, options in planned:  # before anything is asked
        if "model" in options and options["model"] not in (models or {}):
            raise ValueError(f"stage {name}: no model {options['model']!r}; there are {', '.join(sorted(models or {})) or 'none'}")
    for name, verb, source, options in planned:
        if "right" in options:
            options = options | {"right": made[options["right"]]}
        if "model" in options:
            options = options | {"model": models[options["model"]]}
        last = made[name] = VERBS[verb](made[source or INPUT], **options)
    return last


def requests(text: str, df: DataFrame) -> list[tuple[str, str, str | None]]:
    """(stage, verb, first prompt) of the stages that ask a model, without asking: the prompt that the first row of the
    pipeline's input makes, where the stage works on rows of that input (or on some of them); else None."""
    out, rowwise = [], {INPUT}
    for name, verb, source, options in stages(text):
        if verb in ("compare", "has", "contains", "matches", "sort", "sample", "sample_by", "distinct") and (source or INPUT) in rowwise:
            rowwise.add(name)
        if "prompt" in options:
            first = df.limit(1).select(semantic.prompt(options["prompt"], df).alias("p")).first() if (source or INPUT) in rowwise and verb in ("map", "extend", "filter") else None
            out.append((name, verb, first.p if first else None))
    return out


def describe(text: str) -> list[str]:
    """A line for each stage, without running any."""
    return [f"{name}: {verb}({', '.join(f'{k}={v!r}' for k, v in options.items())}) on {source or 'input'}" for name, verb, source, options in stages(text)]

"""Graphs of named things: windows, co-occurrence edges, nodes, folded names, adopted edges, exports."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import chunks, sentences
from ..shared import materialize
from ..sources import writers
from . import semantic
from .rows import numbered
from .vectors import leaders

#: References that an edge shows; the others are counted as hidden.
REFS = 20
#: Snippets of an edge that a model sees, and their characters.
SNIPPETS, SNIPPET = 3, 400
FACTS = 'Give the facts of the text as JSON: {{"triples": [{{"subject": "", "relation": "", "object": ""}}]}}\n<input>\n{text}\n</input>'
NAMING = "How does {source} relate to {target}? Answer with a short relation.\n{snippets}"


def windows(df: DataFrame, key: str, text: str, unit: str = "document", budget: int = 2000) -> DataFrame:
    """(window, text): whole texts ("document"), their sentences, or their chunks of ``budget`` tokens, named key:place."""
    if unit == "document":
        return df.select(F.col(key).cast("string").alias("window"), F.col(text).alias("text"))
    if unit not in ("sentence", "chunk"):
        raise ValueError(f"no such unit: {unit}")
    parts = sentences(F.col(text)) if unit == "sentence" else chunks(F.col(text), budget)
    out = df.select(F.col(key).alias("_key"), F.posexplode(parts).alias("_place", "text"))
    return out.select(F.concat_ws(":", F.col("_key").cast("string"), "_place").alias("window"), "text")


def capitalised(text: Column) -> Column:
    """The offline entity finder: runs of capitalised words, two letters or more each."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Z][a-z]+(?:\s[A-Z][a-z]+)*"), F.lit(0)))


def mentions(windows: DataFrame, window: str, text: str, find: Callable[[Column], Column] = capitalised) -> DataFrame:
    """(window, name): the distinct names of each window."""
    return windows.select(F.col(window).alias("window"), F.explode(find(F.col(text))).alias("name")).distinct()


def folded_names(found: DataFrame) -> DataFrame:
    """(name, canonical): names alike in any case share their most frequent spelling (ties: the first in order)."""
    counts = found.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    lead = F.first("name").over(Window.partitionBy(F.lower("name")).orderBy(F.col("n").desc(), "name"))
    return counts.select("name", lead.alias("canonical"), "n")


def fold_near(folded: DataFrame, model: semantic.EmbeddingModel, threshold: float = 0.9) -> DataFrame:
    """``folded_names`` whose canonical names are folded again: by falling count, a name joins the first one whose
    vector's cosine with its own is ``threshold`` or more."""
    heads = folded.groupBy("canonical").agg(F.sum("n").alias("n"))
    placed = materialize(numbered(semantic.embed(heads, "canonical", model), [F.col("n").desc(), F.col("canonical")]), "names")
    target = placed.select(F.col("_n").alias("leader"), F.col("canonical").alias("_to"))
    moves = placed.select("_n", F.col("canonical").alias("_from")).join(leaders(placed, "_n", "vector", threshold), "_n").join(target, "leader")
    return folded.join(moves, F.col("canonical") == F.col("_from")).select("name", F.col("_to").alias("canonical"), "n")


def nodes(found: DataFrame) -> DataFrame:
    """(name, count): canonical names and their windows."""
    return folded_names(found).groupBy(F.col("canonical").alias("name")).agg(F.sum("n").alias("count"))


def cooccurrence(found: DataFrame, min_weight: int = 1, names: DataFrame | None = None) -> DataFrame:
    """(source, target, weight, sources, hidden): pairs of names in one window, source before target; weight counts
    windows, ``sources`` are the first REFS of them. The pairs are the result itself: an edge for each that occurs."""
    names = (folded_names(found) if names is None else names).select("name", "canonical")
    return paired(found.join(names, "name").select("window", F.col("canonical").alias("name")).distinct(), min_weight)


def paired(found: DataFrame, min_weight: int = 1) -> DataFrame:
    """``cooccurrence`` of distinct (window, name). Tasks add up a pair's windows, and keep its REFS least ones only, before
    they shuffle, so a pair in very many windows is no one task's."""
    pairs = found.select("window", F.col("name").alias("source")).join(found.select("window", F.col("name").alias("target")), "window").where("source < target")
    counts = pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= min_weight)
    place = F.row_number().over(Window.partitionBy("source", "target").orderBy("window"))  # a limit that Spark applies by task first
    refs = pairs.withColumn("_p", place).where(F.col("_p") <= REFS).groupBy("source", "target").agg(F.array_sort(F.collect_list("window")).alias("sources"))
    # Every counted pair has references; as a left join, Spark leaves their pass out where nobody reads ``sources``.
    return counts.join(refs, ["source", "target"], "left").withColumn("hidden", F.greatest(F.col("weight") - REFS, F.lit(0)))


def adopt(edges: DataFrame, source: str, target: str, relation: str | None = None, weight: str | None = None) -> DataFrame:
    """(source, relation, target, weight): given directed edges, summed; self loops and missing ends go."""
    e = edges.select(F.trim(F.col(source).cast("string")).alias("source"), (F.col(relation).cast("string") if relation else F.lit("related")).alias("relation"), F.trim(F.col(target).cast("string")).alias("target"), (F.coalesce(F.col(weight), F.lit(1)) if weight else F.lit(1)).alias("w"))
    e = e.where("source is not null and target is not null and source <> '' and target <> '' and lower(source) <> lower(target)")
    return e.groupBy("source", "relation", "target").agg(F.sum("w").alias("weight"))


def triples(df: DataFrame, key: str, text: str, model: semantic.ChatModel, budget: int = 2000) -> DataFrame:
    """(window, subject, relation, object): what a model finds in each chunk, each fact once a chunk. ``adopt`` sums
    them up to edges. Invalid answers and facts that lack an end give none."""
    parts = windows(df, key, text, "chunk", budget)
    answers = semantic.validated(semantic.ask(parts, semantic.prompt(FACTS, parts), model), "triples array<struct<subject:string,relation:string,object:string>>")
    facts = answers.where("not __invalid").select("window", F.explode("_record.triples").alias("t"))
    facts = facts.select("window", *[F.trim(F.col("t").getField(c)).alias(c) for c in ("subject", "relation", "object")])
    return facts.where("subject <> '' and object <> ''").distinct()


def name_edges(edges: DataFrame, texts: DataFrame, model: semantic.ChatModel, top: int = 20) -> DataFrame:
    """(source, target, weight, relation): the ``top`` heaviest co-occurrences, named by a model that sees SNIPPETS of
    their windows' texts (window, text)."""
    best = edges.orderBy(F.col("weight").desc(), "source", "target").limit(top)
    refs = best.select("source", "target", "weight", F.posexplode(F.slice("sources", 1, SNIPPETS)).alias("place", "window"))
    lists = F.array_sort(F.collect_list(F.struct("place", F.substring("text", 1, SNIPPET).alias("t"))))
    seen = refs.join(texts, "window").groupBy("source", "target", "weight").agg(F.array_join(F.transform(lists, lambda x: x["t"]), "\n---\n").alias("snippets"))
    return semantic.ask(seen, semantic.prompt(NAMING, seen), model).select("source", "target", "weight", F.trim("_answer").alias("relation"))


def vault(edges: DataFrame, top: int = 500) -> dict[str, str]:
    """Notes that link to each other, by file name: one for each name of the ``top`` heaviest edges."""
    notes: dict[str, list[str]] = {}
    for r in edges.orderBy(F.col("weight").desc(), "source", "target").select("source", "target", "weight").limit(top).collect():
        for a, b in ((r.source, r.target), (r.target, r.source)):
            notes.setdefault(a, [f"# {a}", ""]).append(f"- [[{b}]] ({r.weight})")
    return {f"{name.replace('/', '-')}.md": "\n".join(lines) + "\n" for name, lines in notes.items()}


def is_dense(n_nodes: int, n_edges: int) -> bool:
    """Whether a graph is too dense to tell much: then a higher least weight helps."""
    return n_nodes >= 20 and density(n_nodes, n_edges) >= 0.8


def density(n_nodes: int, n_edges: int) -> float:
    return 0.0 if n_nodes < 2 else 2 * n_edges / (n_nodes * (n_nodes - 1))


def save(nodes: DataFrame, edges: DataFrame, path: str, form: str = "csv") -> None:
    """The whole graph below ``path``: nodes and edges as "csv" with headers or "json" lines, edges heaviest first."""
    ranked = edges.orderBy(F.col("weight").desc(), "source", "target")
    write = {"csv": writers.csv, "json": writers.jsonl}.get(form)
    if write is None:
        raise ValueError(f"no such form of a whole graph: {form}")
    write(nodes.orderBy("name"), f"{path}/nodes")
    write(ranked, f"{path}/edges")


def export(edges: DataFrame, form: str, top: int = 500) -> str:
    """The ``top`` heaviest edges as text to look at: "dot", "mermaid", "graphml" or "html". ``save`` has all of them."""
    rows = edges.orderBy(F.col("weight").desc(), "source", "target").select("source", "target", "weight").limit(top).collect()
    quoted = lambda s: json.dumps(s, ensure_ascii=False)
    names = sorted({r.source for r in rows} | {r.target for r in rows})
    number = {n: f"n{i}" for i, n in enumerate(names)}
    if form == "dot":
        return "\n".join(["graph {", *(f"  {quoted(r.source)} -- {quoted(r.target)} [weight={r.weight}];" for r in rows), "}"])
    if form == "mermaid":
        return "\n".join(["graph LR", *(f"  {number[n]}[{quoted(n)}]" for n in names), *(f"  {number[r.source]} ---|{r.weight}| {number[r.target]}" for r in rows)])
    if form == "html":
        from html import escape

        cells = "".join(f"<tr><td>{escape(r.source)}</td><td>{escape(r.target)}</td><td>{r.weight}</td></tr>" for r in rows)
        return f"<!doctype html><meta charset='utf-8'><table><tr><th>source</th><th>target</th><th>weight</th></tr>{cells}</table>"
    if form == "graphml":
        from xml.sax.saxutils import quoteattr

        body = [*(f"<node id={quoteattr(n)}/>" for n in names), *(f"<edge source={quoteattr(r.source)} target={quoteattr(r.target)}><data key='weight'>{r.weight}</data></edge>" for r in rows)]
        return "<?xml version='1.0' encoding='UTF-8'?><graphml xmlns='http://graphml.graphdrawing.org/xmlns'><key id='weight' for='edge' attr.name='weight' attr.type='double'/><graph edgedefault='undirected'>" + "".join(body) + "</graph></graphml>"
    raise ValueError(f"no such form: {form}")

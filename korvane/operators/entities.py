"""From texts to a graph without a model: spans of known names, mentions with labels, names folded within a label, nodes
and edges of what stands together."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.texts import sentences
from ..shared import materialize
from . import graph, semantic
from .rows import numbered
from .vectors import leaders

#: A table of names is sent to workers in shards of so many at most.
SHARD = 200_000
WORD = re.compile(r"\w+")
#: start, end (in characters) and label of a name in a text.
Span = tuple[int, int, str]


class EntityFinder(ABC):
    """Finds named things in texts; works inside tasks, so it must pickle."""

    @abstractmethod
    def find(self, text: str) -> list[Span]:
        """Spans in order, none of which overlap."""


def greedy(spans: list[tuple[float, int, int, str]]) -> list[Span]:
    """Of scored spans (score, start, end, label) those that overlap no better one; better is a higher score, then an
    earlier start, then the longer one."""
    taken: list[Span] = []
    for _, start, end, label in sorted(spans, key=lambda s: (-s[0], s[1], -s[2], s[3])):
        if all(end <= a or start >= b for a, b, _ in taken):
            taken.append((start, end, label))
    return sorted(taken)


@dataclass
class Gazetteer(EntityFinder):
    """Names found by a trie of their words: at each word the longest name that begins there, from left to right without
    overlap. With ``fold``, case does not matter. Of several labels of a name the first one in order counts."""

    fold: bool = False
    trie: dict = field(default_factory=dict)

    def add(self, name: str, label: str) -> None:
        node = self.trie
        for w in WORD.findall(name.casefold() if self.fold else name):
            node = node.setdefault(w, {})
        if node is not self.trie:
            node[""] = min(label, node.get("", label))

    def longest(self, text: str) -> Iterator[Span]:
        """At each word, the longest name that begins there."""
        words = [(m.start(), m.end(), m[0].casefold() if self.fold else m[0]) for m in WORD.finditer(text)]
        for i, (start, _, _) in enumerate(words):
            node, best = self.trie, None
            for _, end, w in words[i:]:
                node = node.get(w)
                if node is None:
                    break
                if "" in node:
                    best = (start, end, node[""])
            if best:
                yield best

    def find(self, text: str) -> list[Span]:
        return without_overlap(self.longest(text))


def without_overlap(spans: Iterator[Span]) -> list[Span]:
    """Of spans by growing start, each that begins where the last one taken has ended, or later."""
    out: list[Span] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


MENTION = "start long, end long, name string, label string"


def mentions_of(df: DataFrame, key: str, text: str, finder: EntityFinder) -> DataFrame:
    """(key, start, end, name, label): every span that ``finder`` sees in a text. Null texts have none."""
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL(MENTION).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, a, b, t[a:b], label) for k, t in zip(pdf[key], pdf["_text"]) if t is not None for a, b, label in finder.find(t)]
            yield pd.DataFrame(rows, columns=schema.names)

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text")).mapInPandas(run, schema)


def gazetteer_mentions(df: DataFrame, key: str, text: str, names: DataFrame, fold: bool = False) -> DataFrame:
    """``mentions_of`` for a table ``names`` (name, label) of any size.

    Up to SHARD names make one trie that every worker has. More are dealt out by their first word to several tries; each
    shard's pass finds the longest name at each word, and as a word belongs to one shard, dropping overlaps per text
    afterwards gives the same spans.
    """
    names = materialize(names.where("name is not null").groupBy("name").agg(F.min("label").alias("label")), "names")
    shards = max(1, -(-names.count() // SHARD))
    first = F.regexp_extract(F.lower("name") if fold else F.col("name"), r"(?U)(\w+)", 1)
    found = None
    for s in range(shards):
        finder = Gazetteer(fold)
        for r in names.where(F.pmod(F.xxhash64(first), F.lit(shards)) == s).toLocalIterator():
            finder.add(r.name, r.label)
        if shards == 1:
            return mentions_of(df, key, text, finder)
        some = mentions_of(df, key, text, _All(finder))
        found = some if found is None else found.unionByName(some)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ends = None, 0  # the text that rows are of, and where its last span taken has ended
        for batch in batches:
            kept = []
            for k, start, end in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if k != last and (k == k or last == last):
                    last, ends = k, 0
                kept.append(start >= ends)
                ends = end if kept[-1] else ends
            yield batch.filter(pa.array(kept, pa.bool_()))

    # A text's spans follow each other in a sorted partition, so no group is handed to Python on its own.
    ordered = found.repartition(F.col(f"`{key}`")).sortWithinPartitions(F.col(f"`{key}`"), "start")
    return ordered.mapInArrow(resolve, found.schema)


@dataclass
class _All(EntityFinder):
    """A gazetteer's longest names at every word, overlaps and all."""

    inner: Gazetteer

    def find(self, text: str) -> list[Span]:
        return list(self.inner.longest(text))


def capitalised_names(df: DataFrame, text: str, key: str, least: int = 2, pattern: str = r"[A-Z][a-z]+(?:\s[A-Z][a-z]+)*", label: str = "name") -> DataFrame:
    """(name, label): a gazetteer from the corpus itself, the capitalised runs that stand in ``least`` rows or more."""
    found = df.select(F.col(f"`{key}`").alias("_key"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(f"`{text}`"), F.lit(pattern), F.lit(0)))).alias("name"))
    return found.groupBy("name").agg(F.countDistinct("_key").alias("n")).where(F.col("n") >= least).select("name", F.lit(label).alias("label"))


def surface_counts(mentions: DataFrame, key: str) -> DataFrame:
    """(name, label, n, first): how often each spelling is mentioned with a label, and where first, by key and start."""
    return mentions.groupBy("name", "label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col(f"`{key}`").alias("key"), "start")).alias("first"))


def folded(counts: DataFrame, model: semantic.EmbeddingModel | None = None, threshold: float = 0.9) -> DataFrame:
    """(name, label, canonical, n): within a label, spellings alike in any case are one name, the most frequent of them
    (of equals the first to appear). With a ``model``, by falling count a name then joins the first one whose vector's
    cosine with its own is ``threshold`` or more."""
    counts = counts.withColumn("_low", F.lower("name"))
    lead = F.min(F.struct((-F.col("n")).alias("most"), "first", "name")).alias("lead")
    heads = counts.groupBy("label", "_low").agg(lead, F.sum("n").alias("total"), F.min("first").alias("seen"))
    out = counts.join(heads.select("label", "_low", F.col("lead.name").alias("canonical")), ["label", "_low"]).select("name", "label", "canonical", "n")
    if model is None:
        return out
    heads = materialize(heads.select("label", F.col("lead.name").alias("canonical"), "total", "seen"), "fold-heads")
    moved = None
    for r in heads.select("label").distinct().orderBy("label").toLocalIterator():  # one pass for each label that a finder has
        mine = heads.where(F.col("label").eqNullSafe(F.lit(r.label)))
        placed = materialize(numbered(semantic.embed(mine, "canonical", model), [F.col("total").desc(), F.col("seen")]), "fold-names")
        target = placed.select(F.col("_n").alias("leader"), F.col("canonical").alias("_to"))
        some = placed.select("_n", "label", F.col("canonical").alias("_from")).join(leaders(placed, "_n", "vector", threshold), "_n").join(target, "leader").select("label", "_from", "_to")
        moved = some if moved is None else moved.unionByName(some)
    if moved is None:
        return out
    moved = moved.withColumnRenamed("label", "_label")
    joined = out.join(moved, F.col("label").eqNullSafe(F.col("_label")) & (F.col("canonical") == F.col("_from")), "left")
    return joined.select("name", "label", F.coalesce("_to", "canonical").alias("canonical"), "n")


@dataclass
class Graph:
    """What texts mention (key, start, end, name, label), the names as folded (name, label, canonical, n), nodes (name,
    label, count) and edges (source, target, weight, sources, hidden)."""

    mentions: DataFrame
    names: DataFrame
    nodes: DataFrame
    edges: DataFrame


def nodes_of(names: DataFrame) -> DataFrame:
    """(name, label, count): canonical names with all their mentions, under the label that most of these have (of equals
    the first in order)."""
    votes = names.groupBy("canonical", "label").agg(F.sum("n").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("most"), "label"))
    return votes.groupBy(F.col("canonical").alias("name")).agg(best.alias("b"), F.sum("n").alias("count")).select("name", F.col("b.label").alias("label"), "count")


def fast_graph(df: DataFrame, key: str, text: str, names: DataFrame | EntityFinder, unit: str = "item", document: str | None = None, min_weight: int = 1, model: semantic.EmbeddingModel | None = None, threshold: float = 0.9, fold: bool = False) -> Graph:
    """The graph of the names in texts. ``names`` is a table (name, label) or a finder; ``key`` tells texts apart and
    orders them.

    Names stand together in one text ("item"), one sentence ("sentence") or the texts of one ``document``. Edges are
    pairs of different canonical names, source before target, with the number of windows that have both; those below
    ``min_weight`` go. Null and empty texts mention nothing. A window of very many names has all their pairs: they are
    the result.
    """
    if unit not in ("item", "sentence", "document") or (unit == "document") != (document is not None):
        raise ValueError("unit is item, sentence, or document with the column that names one")
    texts = df.select(F.col(f"`{key}`").alias("_k"), F.col(f"`{text}`").alias("_t"), *([F.col(f"`{document}`").cast("string").alias("_d")] if document else []))
    if unit == "sentence":
        texts = texts.select("_k", F.posexplode(sentences(F.col("_t"))).alias("_s", "_t")).select(F.struct("_k", "_s").alias("_k"), "_t")
    found = mentions_of(texts, "_k", "_t", names) if isinstance(names, EntityFinder) else gazetteer_mentions(texts, "_k", "_t", names, fold)
    found = materialize(found, "graph-mentions")
    folding = materialize(folded(surface_counts(found, "_k"), model, threshold), "graph-names")
    if document:
        window = texts.select("_k", F.col("_d").alias("window"))
        placed = found.join(window, "_k")
    else:
        placed = found.withColumn("window", F.to_json(F.struct("_k")) if unit == "sentence" else F.col("_k").cast("string"))
    known = folding.select(F.col("name").alias("_n"), F.col("label").alias("_l"), "canonical")
    canonical = placed.join(known, (F.col("name") == F.col("_n")) & F.col("label").eqNullSafe(F.col("_l"))).select("window", F.col("canonical").alias("name")).distinct()
    edges = graph.paired(canonical, min_weight)
    return Graph(found.withColumnRenamed("_k", "key"), folding, nodes_of(folding), edges)

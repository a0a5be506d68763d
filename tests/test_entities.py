"""Spans, folding and graphs of names, against plain loops."""

import re
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from korvane.operators import entities, graph, semantic

NAMES = [("New York", "place"), ("New York Times", "paper"), ("York", "place"), ("Ann", "person"), ("ann lee", "person"), ("Lee", "person"), ("Ann", "a"), (None, "x"), ("Übung", "thing"), ("!!", "none")]
TEXTS = [(1, "Ann reads the New York Times in New York. Ann Lee, of York!"), (2, "ANN LEE met Lee; New  York Übung-Übung"), (3, None), (4, ""), (5, "NewYork Annie York_ Lee's")]


def plain_spans(text, names, fold):
    """Left to right, the longest name at each word."""
    same = str.casefold if fold else str
    words = [(m.start(), m.end(), same(m[0])) for m in re.finditer(r"\w+", text)]
    known = {}
    for n, label in names:
        w = tuple(re.findall(r"\w+", same(n))) if n else ()
        if w:
            known[w] = min(label, known.get(w, label))
    out, i = [], 0
    while i < len(words):
        best = max((k for k in range(1, len(words) - i + 1) if tuple(w for _, _, w in words[i : i + k]) in known), default=0)
        if best:
            out.append((words[i][0], words[i + best - 1][1], known[tuple(w for _, _, w in words[i : i + best])]))
        i += best or 1
    return out


@pytest.mark.parametrize("fold", [False, True])
@pytest.mark.parametrize("shard", [200_000, 2])
def test_spans(spark, monkeypatch, fold, shard):
    monkeypatch.setattr(entities, "SHARD", shard)  # the small one deals names out to several tries
    df = spark.createDataFrame(TEXTS, "i long, t string").withColumns({"start": F.lit(1), "name": F.lit("x"), "_text2": F.lit(0)})
    names = spark.createDataFrame(NAMES, "name string, label string")
    got = {}
    for r in entities.gazetteer_mentions(df, "i", "t", names, fold).collect():
        got.setdefault(r.i, []).append((r.start, r.end, r.label))
    for i, t in TEXTS:
        assert sorted(got.get(i, [])) == plain_spans(t or "", NAMES, fold)


def test_greedy():
    spans = [(0.9, 0, 5, "a"), (0.95, 3, 8, "b"), (0.9, 5, 9, "c"), (0.5, 8, 10, "d"), (0.95, 20, 22, "e")]
    assert entities.greedy(spans) == [(3, 8, "b"), (8, 10, "d"), (20, 22, "e")]


def test_folding_within_labels(spark):
    rows = [("Ann", "p", 2, 1), ("ANN", "p", 2, 0), ("ann", "q", 5, 0), ("Bob", "p", 1, 4), ("bob", "p", 3, 9)]
    counts = spark.createDataFrame(rows, "name string, label string, n long, o long").withColumn("first", F.struct("o", F.lit(0).alias("s"))).drop("o")
    got = {(r.name, r.label): r.canonical for r in entities.folded(counts).collect()}
    assert got == {("Ann", "p"): "ANN", ("ANN", "p"): "ANN", ("ann", "q"): "ann", ("Bob", "p"): "bob", ("bob", "p"): "bob"}
    nodes = {r.name: (r.label, r["count"]) for r in entities.nodes_of(entities.folded(counts)).collect()}
    assert nodes == {"ANN": ("p", 4), "ann": ("q", 5), "bob": ("p", 4)}


@dataclass
class Lengths(semantic.EmbeddingModel):
    """Names of one length are alike."""

    name: str = "lengths"

    def embed(self, texts):
        return [[1.0 if len(t) == k else 0.0 for k in range(1, 9)] for t in texts]


def test_folding_by_vectors(spark):
    rows = [("abc", "p", 1, 1), ("xyz", "p", 9, 2), ("lmno", "p", 1, 3), ("qrs", "q", 1, 4)]
    counts = spark.createDataFrame(rows, "name string, label string, n long, o long").withColumn("first", F.struct("o", F.lit(0).alias("s"))).drop("o")
    got = {r.name: r.canonical for r in entities.folded(counts, Lengths()).collect()}
    assert got == {"abc": "xyz", "xyz": "xyz", "lmno": "lmno", "qrs": "qrs"}


def test_graph(spark, tmp_path):
    rows = [(1, "d1", "Ann met Bob. Cid slept."), (2, "d1", "Bob met ANN"), (3, "d2", "Cid met Ann; Ann left"), (4, "d2", None)]
    df = spark.createDataFrame(rows, "i long, d string, t string")
    names = spark.createDataFrame([("Ann", "p"), ("ANN", "p"), ("Bob", "p"), ("Cid", "p")], "name string, label string")
    edges = lambda g: {(r.source, r.target): r.weight for r in g.edges.collect()}
    item = entities.fast_graph(df, "i", "t", names)
    assert edges(item) == {("Ann", "Bob"): 2, ("Ann", "Cid"): 2, ("Bob", "Cid"): 1}
    assert {r.name: r["count"] for r in item.nodes.collect()} == {"Ann": 4, "Bob": 2, "Cid": 2}
    assert edges(entities.fast_graph(df, "i", "t", names, "sentence")) == {("Ann", "Bob"): 2, ("Ann", "Cid"): 1}
    assert edges(entities.fast_graph(df, "i", "t", names, "document", "d")) == {("Ann", "Bob"): 1, ("Ann", "Cid"): 2, ("Bob", "Cid"): 1}
    assert edges(entities.fast_graph(df, "i", "t", names, min_weight=2)) == {("Ann", "Bob"): 2, ("Ann", "Cid"): 2}
    assert entities.fast_graph(df.limit(0), "i", "t", names).edges.count() == 0
    with pytest.raises(ValueError):
        entities.fast_graph(df, "i", "t", names, "document")
    graph.save(item.nodes, item.edges.drop("sources"), str(tmp_path / "g"))
    assert spark.read.csv(str(tmp_path / "g/edges"), header=True).count() == 3
    graph.save(item.nodes, item.edges, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j/nodes")).count() == 3


def test_pairs_of_many_windows(spark):
    df = spark.range(300).select(F.format_string("w%03d", "id").alias("window"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("name"))
    r = graph.paired(df).first()
    assert (r.source, r.target, r.weight, r.hidden, r.sources) == ("a", "b", 300, 280, [f"w{i:03d}" for i in range(20)])


def test_shards_of_names_make_no_groups_in_python(spark, monkeypatch):
    texts = [("a b", f"x{i % 7} a b c x{i % 5} c d a") for i in range(40)]
    df = spark.createDataFrame([(i if i else None, t) for i, (_, t) in enumerate(texts)], "k long, t string")
    names = spark.createDataFrame([(n, "l") for n in ("a b", "b c", "c", "a", "b c x1 c", "d a", *(f"x{i}" for i in range(7)))], "name string, label string")
    plain = sorted(map(tuple, entities.gazetteer_mentions(df, "k", "t", names).collect()), key=repr)
    monkeypatch.setattr(entities, "SHARD", 4)
    sharded = entities.gazetteer_mentions(df, "k", "t", names)
    assert sorted(map(tuple, sharded.collect()), key=repr) == plain
    assert "FlatMapGroups" not in sharded._jdf.queryExecution().toString()


def test_edges_without_references_are_counted_in_one_pass(spark):
    found = spark.createDataFrame([(w, n) for w in range(30) for n in "abc"[: 1 + w % 3]], "window long, name string")
    edges = graph.paired(found, 2)
    assert sorted((r.source, r.target, r.weight, len(r.sources), r.hidden) for r in edges.collect()) == [("a", "b", 20, 20, 0), ("a", "c", 10, 10, 0), ("b", "c", 10, 10, 0)]
    plan = edges.drop("sources")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan

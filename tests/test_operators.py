import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from korvane.functions import fields, predicates, texts, times
from korvane.operators import graph, rows, semantic, tables, vectors
from korvane.plans import pipelines
from korvane.sources import readers, writers
from korvane.streaming import live


def test_paths(spark):
    df = spark.createDataFrame([(1, [10, 20], {"x": 5}, "lit")], "a int, items array<int>, m map<string,int>, `d.e` string")
    got = df.select(*[fields.field(df, p).alias(str(i)) for i, p in enumerate(["a", "items[0]", "items[-1]", "items[9]", "m.x", "d.e", "no.such"])]).first()
    assert list(got) == [1, 10, 20, None, 5, "lit", None]
    assert fields.hops("a.b[2]['c d'].e") == ["a", "b", 2, "c d", "e"]
    with pytest.raises(ValueError):
        fields.hops("a[")


def test_json_paths(spark):
    df = spark.createDataFrame([('{"a":{"b":[1,2,3]},"x.y":7}',), ("nope",), (None,)], "r string")
    got = df.select(fields.json_field(F.col("r"), "a.b[-1]", "int"), fields.json_field(F.col("r"), "x.y", "int"), fields.json_field(F.col("r"), "a.b[0]", "int")).collect()
    assert [list(r) for r in got] == [[3, 7, 1], [None] * 3, [None] * 3]


def test_compare_ladder(spark):
    df = spark.createDataFrame([("10",), ("9",), ("abc",), ("2024-01-02",), (None,), ("5d",)], "v string")
    keep = lambda *a: [r.v for r in df.where(predicates.compare(F.col("v"), *a)).collect()]
    assert keep(">", 9) == ["10"]
    assert keep("==", "10") == ["10"]
    assert keep("<", "2025-01-01") == ["2024-01-02"]
    assert keep("!=", "abc") == ["10", "9", "2024-01-02", "5d"]
    assert df.where(~predicates.compare(F.col("v"), "==", "10")).count() == 5  # a missing field is false, its negation true


def test_word_match(spark):
    df = spark.createDataFrame([("an Error, here",), ("errors",), ("x_error",), (None,)], "v string")
    assert df.where(predicates.has(F.col("v"), "ERROR")).count() == 1
    assert df.where(predicates.contains(F.col("v"), "ERROR")).count() == 3


def test_summarize_kinds(spark):
    df = spark.createDataFrame([("a", 1.0, "7"), ("a", 3.0, "8"), (None, None, "9")], "g string, x double, s string")
    got = {r.g: r for r in tables.summarize(df, [("count", None), ("sum", "x"), ("p50", "x"), ("sum", "s"), ("dcount", "s")], ["g"]).collect()}
    assert (got["a"]["count"], got["a"]["sum_x"], got["a"]["p50_x"], got["a"]["sum_s"]) == (2, 4.0, 1.0, None)
    assert got[None]["count"] == 1 and got[None]["p50_x"] is None
    assert tables.summarize(df.limit(0), [("count", None)]).count() == 0


def test_percentiles_against_sorting(spark):
    """One hot group with ties, a group without values, a null group; more groups than partitions."""
    data = [("hot", float((i * 7919) % 101)) for i in range(900)] + [(f"g{i % 9}", i / 7) for i in range(100)] + [("none", None), (None, 3.0), (None, None)]
    df = spark.createDataFrame(data, "g string, x double")
    got = {r.g: r for r in tables.summarize(df, [("count", None), *((p, "x") for p in tables.QUANTILES)], ["g"]).collect()}
    for g in {g for g, _ in data}:
        v = sorted(x for h, x in data if h == g and x is not None)
        assert got[g]["count"] == sum(h == g for h, _ in data)
        assert all(got[g][f"{p}_x"] == (round(v[round(q * (len(v) - 1))], 4) if v else None) for p, q in tables.QUANTILES.items())
    every = sorted(x for _, x in data if x is not None)
    assert tables.summarize(df, [("p90", "x")]).collect()[0]["p90_x"] == round(every[round(0.9 * (len(every) - 1))], 4)


def test_bins(spark):
    df = spark.createDataFrame([("2024-01-01T10:07:00Z",), ("bad",)], "t string")
    assert [r[0] for r in df.select(times.bin_label(times.bin_start(F.col("t"), "15m", "string"), "15m")).collect()] == ["10:00", None]
    df = spark.createDataFrame([("Jan 5, 2026",), ("2026/1/5",), ("01/05/2026",), ("5 January 2026",), ("soon",)], "t string")
    assert [r[0] for r in df.select(times.coerce_date(F.col("t"))).collect()] == ["2026-01-05"] * 4 + [None]
    assert [r[0] for r in df.select(times.ambiguous_date(F.col("t"))).collect()] == [False, False, True, False, False]


def test_samples(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i % 7 else None) for i in range(200)], "o int, g string")
    assert rows.sample(df, 20, "o", 1).count() == 20 and rows.sample(df, 999, "o").count() == 200
    assert rows.sample(df, 20, "o", 1).collect() == rows.sample(df, 20, "o", 1).collect()
    assert rows.quotas(df, 50, "g").agg(F.sum("quota")).first()[0] == 50
    assert rows.sample_by(df, 50, "g", "o").count() == 50


def test_sorting(spark):
    df = spark.createDataFrame([("2024-02-01", 1), ("2024-01-01T05:00:00", 2), (None, 3)], "t string, o int")
    assert [r.o for r in rows.sort_by(df, "t", order=["o"]).collect()] == [2, 1, 3]
    assert [r.o for r in rows.sort_by(df, "t", True, ["o"]).collect()] == [1, 2, 3]
    df = spark.createDataFrame([("10", 1), ("9", 2), ("b", 3), (None, 4)], "v string, o int")
    assert [r.o for r in df.orderBy(*rows.mixed_sort_keys(F.col("v"))).collect()] == [2, 1, 3, 4]


def test_joins(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k int, v string"), spark.createDataFrame([("1", 5), (None, 6)], "k string, w int")
    assert [(r.left.v, r.right.w) for r in rows.join_on(a, b, [("k", "k")]).collect()] == [("x", 5)]
    assert {r.v for r in rows.join_on(a, b, [("k", "k")], "anti").collect()} == {"y", "z"}
    assert {(r.left.v, r.right and r.right.w) for r in rows.join_on(a, b, [("k", "k")], "leftouter").collect()} == {("x", 5), ("y", None), ("z", None)}


def test_distinct_and_explode(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, None), (4, None, None)], "o int, v string, w int")
    assert sorted(r.o for r in rows.distinct_exact(df, "o").collect()) == [1, 3]
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "o int, v array<string>")
    assert [(r.o, r.v) for r in rows.explode_field(df, "v").collect()] == [(1, "a"), (1, "b"), (3, None)]


@pytest.mark.parametrize(("n", "size", "every"), [(7, 3, None), (5, 3, 1), (2, 5, 2), (0, 3, 1), (12, 4, 3), (9, 3, 3)])
def test_count_windows(spark, n, size, every):
    step, buffer, want, since = every or size, [], [], []
    for i in range(1, n + 1):
        buffer.append(i)
        since.append(i)
        if i >= size and (i - size) % step == 0:
            want.append((i, False, tuple(buffer[-size:])))
            since = []
    if since:
        want.append((n, True, tuple(since)))
    df = spark.createDataFrame([(i,) for i in range(1, n + 1)], "o int")
    out = rows.count_windows(df, ["o"], size, every).groupBy("window_end", "partial").agg(F.array_sort(F.collect_list("o")).alias("m")).collect()
    assert sorted((r.window_end, r.partial, tuple(r.m)) for r in out) == sorted(want)


def _greedy(v, t):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    lead = []
    out = []
    for i in range(len(u)):
        near = [j for j in lead if u[j] @ u[i] >= t]
        out.append(near[0] if near else i)
        lead += [] if near else [i]
    return out


def test_leaders_match_the_sequential_rule(spark, monkeypatch):
    monkeypatch.setattr(vectors, "HEAD", 16)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(150, 3))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "o long, v array<double>")
    got = {r.o: r.leader for r in vectors.leaders(df, "o", "v", 0.8).collect()}
    assert [got[i] for i in range(150)] == _greedy(v, 0.8)
    assert vectors.merge_to_k([5, 1, 4], np.array([[1.0, 0], [0.9, 0.1], [0, 1.0]]), 2) == [0, 0, 2]


def test_similarity_recall(spark):
    rng = random.Random(42)
    a = [(i, [rng.random(), rng.random(), rng.random()]) for i in range(40)]
    df = spark.createDataFrame(a, "o long, v array<double>")
    full = vectors.similarity_join(df, df, 40, "o", "o", "v")
    assert full.count() == 1600
    assert full.where("rank = 1 and left_id = right_id").count() == 40


def test_threshold_search_has_no_limit(spark, tmp_path):
    from korvane.catalogue import QUERIES

    n = 1_000_050
    vector = F.array(F.lit(1.0), F.lit(0.0)).cast("array<float>")
    spark.range(n).select(F.col("id").alias("vec_id"), vector.alias("embedding"), F.lit(0).alias("label")).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["topk_threshold"](spark, str(tmp_path)).count() == n


@pytest.mark.parametrize("by", [[], ["g"]])
def test_reduce_rows_brings_no_group_together(spark, monkeypatch, by):
    plans, write = [], semantic.materialize
    monkeypatch.setattr(semantic, "materialize", lambda df, tag: (plans.append((tag, df._jdf.queryExecution().executedPlan().toString())), write(df, tag))[1])
    df = spark.createDataFrame([(None if i % 3 == 0 else "ab"[i % 2], i, str(i)) for i in range(60)], "g string, o long, t string")
    got = semantic.reduce_rows(df, "t", "o", "{items}", semantic.RuleChat(lambda p: "+".join(p.split("\n"))), by, 4).collect()
    want = {}
    for r in df.collect():
        if not by or r.g is not None:  # rows with a missing key are left out
            want.setdefault(r.g if by else None, []).append(r.t)
    assert {(r.g if by else None): r.result for r in got} == {g: "+".join(v) for g, v in want.items()} and len(got) == len(want)
    assert all("Window" not in plan for tag, plan in plans if tag == "reduce")


def test_zero_vector(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "o long, v array<double>")
    assert [(r.o, r["__score"]) for r in vectors.top_k(df, "v", [1.0, 0.0], 2, "o").collect()] == [(2, 1.0), (1, 0.5)]
    assert vectors.outliers(df, "o", "v").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n.漢", max_size=300), st.integers(1, 40))
def test_chunks_join(text, budget):
    assert "".join(texts.chunks_of(text, budget)) == text


def test_greedy_leaders_by_blocks(monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "HEAD_BLOCK", 7)
    rng = np.random.default_rng(2)
    v = vectors._unit(np.concatenate([rng.normal(size=(60, 3)), np.zeros((2, 3)), rng.normal(size=(40, 3))]))
    chosen, first = vectors._greedy(v, 0.9)
    want: list[int] = []
    for i in range(len(v)):
        near = [k for k in want if v[k] @ v[i] >= 0.9 - 1e-12]
        want += [] if near else [i]
        assert first[i] == (near or [i])[0]
    assert chosen == want


def test_cuts_of_a_line():
    for n in (2001, 2003, 6002, 40019):  # lines whose length the number of cuts does not divide
        line = "".join(chr(97 + i % 26) for i in range(n))
        cuts, width = -(-texts.tokens_of(line) // 500), n // -(-texts.tokens_of(line) // 500)
        assert [len(c) for c in texts.chunks_of(line, 500)] == [width] * (cuts - 1) + [n - width * (cuts - 1)]
        assert texts.chunks_of("short\n" + line, 500)[-1] == line[width * (cuts - 1) :]


def test_texts(spark):
    df = spark.createDataFrame([("<p>Hi&nbsp;<b>you</b></p><script>x<y</script><div>A &amp; B</div>",), (None,)], "h string")
    assert [r[0] for r in df.select(texts.html_text(F.col("h"))).collect()] == ["Hi you\nA & B", ""]
    df = spark.createDataFrame([('One. "Two!" Three\n\nFour',)], "t string")
    assert df.select(texts.sentences(F.col("t"))).first()[0] == ["One.", '"Two!"', "Three", "Four"]
    df = spark.createDataFrame([(" ".join(f" {i} then {i}. " for i in range(120)),)], "t string")
    assert df.select(texts.sentences(F.col("t"))).first()[0] == [f"{i} then {i}." for i in range(120)]
    assert texts.repaired("x ```json\n{a: 1, 'b': [1,2,],}\n```") == '{"a":1,"b":[1,2]}'
    assert texts.repaired("none") is None
    assert texts.repaired('{"a": "x, ]", b: 1}') == '{"a":"x, ]","b":1}'
    assert texts.repaired('{"a": "{b: True,}", "c": True,}') == '{"a":"{b: True,}","c":true}'
    assert texts.repaired("say {'a': 'it''s', } now") == '{"a":"its"}'
    assert texts.repaired("Answer: [1, 2,] and more") == "[1,2]"


def test_graph(spark):
    found = spark.createDataFrame([(1, "Ann"), (1, "Bob"), (2, "Ann"), (2, "bob"), (3, "Bob")], "window long, name string")
    edges = graph.cooccurrence(found)
    assert [(r.source, r.target, r.weight, r.sources) for r in edges.collect()] == [("Ann", "Bob", 2, [1, 2])]
    for form in ("dot", "mermaid", "graphml", "html"):
        assert "Bob" in graph.export(edges, form)
    e = spark.createDataFrame([("a", "b", 2), ("a", "b", 3), ("a", "A", 1), (None, "b", 1)], "s string, t string, w int")
    assert [(r.source, r.target, r.weight) for r in graph.adopt(e, "s", "t", None, "w").collect()] == [("a", "b", 5)]


def test_graph_from_texts(spark):
    df = spark.createDataFrame([(1, "Ann met Bob. Ann left."), (2, "Bob saw Ann."), (3, None)], "o long, t string")
    assert [r.window for r in graph.windows(df, "o", "t", "sentence").orderBy("window").collect()] == ["1:0", "1:1", "2:0"]
    said = graph.windows(df.where("t is not null"), "o", "t")
    edges = graph.cooccurrence(graph.mentions(said, "window", "text"))
    seen = semantic.RuleChat(lambda p: " met " if "Ann met" in p and "Bob saw" in p else "?")
    assert [(r.source, r.target, r.relation) for r in graph.name_edges(edges, said, seen).collect()] == [("Ann", "Bob", "met")]
    assert graph.vault(edges)["Ann.md"] == "# Ann\n\n- [[Bob]] (2)\n"
    facts = semantic.RuleChat(lambda p: '{"triples":[{"subject":"Ann","relation":"met","object":"Bob"},{"subject":"Ann","relation":"met","object":"Bob"}]}' if "met Bob" in p else "none")
    assert [tuple(r)[1:] for r in graph.triples(df, "o", "t", facts).collect()] == [("Ann", "met", "Bob")]
    assert graph.is_dense(20, 190) and not graph.is_dense(5, 10)


def test_names_fold_by_vector(spark):
    found = spark.createDataFrame([(1, "Acme Corp"), (2, "Acme Corp"), (3, "Corp Acme"), (4, "Other")], "window long, name string")
    folded = graph.fold_near(graph.folded_names(found), semantic.HashingEmbedder())
    assert {r.name: r.canonical for r in folded.collect()} == {"Acme Corp": "Acme Corp", "Corp Acme": "Acme Corp", "Other": "Other"}


def test_cluster_examples(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.2], "b"), (3, [1.0, 0.1], "c"), (4, [0.0, 1.0], "d")], "o long, v array<double>, t string")
    found = vectors.cluster_examples(vectors.cluster(df, "o", "v", 0.9), df, "o", "v", "t", 1)
    assert {(r.cluster, r.o, r.example) for r in found.collect()} == {(1, 3, "c"), (2, 4, "d")}
    assert {tuple(r) for r in semantic.label_clusters(found, semantic.RuleChat(lambda p: "cs" if p.endswith("c") else "")).collect()} == {(1, "cs"), (2, "cluster 2")}


def test_guarded_models():
    def odd(p):
        if int(p) % 2:
            raise ValueError(p)
        return p

    assert semantic.Guarded(semantic.RuleChat(odd)).complete(["1", "2", "3", "4"]) == [None, "2", None, "4"]
    with pytest.raises(RuntimeError):
        semantic.Guarded(semantic.RuleChat(odd)).complete(["1", "3", "5", "7", "9"])


def test_semantic(spark):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "o int, t string")
    chat = semantic.RuleChat(lambda p: '{"n": %d}' % len(p) if "good" in p else "sorry")
    assert [(r.n, r["__invalid"]) for r in semantic.map_rows(df, "{t}", chat, "n int", keep_invalid=True).collect()] == [(4, False), (None, True)]
    assert [(r.o, r.n) for r in semantic.extend_rows(df, "{t}", chat, "n int").collect()] == [(1, 4), (2, None)]
    assert [r["__embedder"] for r in semantic.embed(df, "t", semantic.HashingEmbedder()).collect()] == ["hashing-64"] * 2
    many = spark.createDataFrame([(i, str(i)) for i in range(57)], "o int, t string")
    total = semantic.RuleChat(lambda p: str(sum(map(int, p.split("\n")))))
    assert semantic.reduce_rows(many, "t", "o", "{items}", total, fan_in=5).first().result == str(sum(range(57)))
    long = spark.createDataFrame([(1, "x" * 100 + "\n\nneedle"), (2, "y" * 100)], "o int, t string")
    assert [r.o for r in semantic.filter_long(long, "o", "t", "{chunk}", semantic.RuleChat(lambda p: "yes" if "needle" in p else "no"), 10).collect()] == [1]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\r\n\n{"a":2}\n')
    assert readers.records(spark, [str(tmp_path / "a.jsonl")]).count() == 2
    (tmp_path / "b.jsonl").write_text('{"a":1}\n[1]\n')
    assert readers.records(spark, [str(tmp_path / "b.jsonl")], strict=False).where("data is null").count() == 1
    with pytest.raises(Exception, match="not a JSON object"):
        readers.records(spark, [str(tmp_path / "b.jsonl")]).collect()
    (tmp_path / "c.csv").write_text('n,s\n1,"x\ny"\n2,z\n')
    df = readers.number_columns(readers.csv(spark, [str(tmp_path / "c.csv")]))
    assert [(r.n, r.s) for r in df.collect()] == [(1, "x\ny"), (2, "z")]
    writers.by_template(df, str(tmp_path / "out"), "{n}", "n")
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["target=1", "target=2"]
    writers.jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    writers.csv(df.withColumn("l", F.array("n")), str(tmp_path / "v"), "\t")
    assert spark.read.csv(str(tmp_path / "v"), sep="\t", header=True).count() == 2
    assert readers.files(spark, [str(tmp_path / "c.csv")]).first().kind == "text"
    t = tables.tally(df, "s")
    assert writers.bars(t).count("\n") >= 1 and writers.svg(t).startswith("<svg")


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(40)], "o long, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.parquet_stream(spark, str(tmp_path / "in"), df.schema)
    q = live.count_windows(stream, 10, "v").writeStream.format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.window_end, r.total) for r in spark.sql("select * from w").collect()) == [(10, 45.0), (20, 45.0), (30, 45.0), (40, 45.0)]


def test_pipelines(spark):
    df = spark.createDataFrame([("a", 5), ("b", 50)], "g string, x int")
    text = '[stage.one]\nverb = "compare"\nfield = "x"\nop = ">"\nto = 10\n[stage.two]\nverb = "fields"\nfields_ = ["g"]\n'
    assert [r.g for r in pipelines.run(text, df).collect()] == ["b"]
    assert pipelines.describe(text)[1].startswith("two: fields")
    with pytest.raises(ValueError):
        pipelines.stages('[stage.x]\nverb = "nope"\n')


def test_pipelines_of_two_tables(spark):
    df = spark.createDataFrame([("a", 5), ("b", 50), ("b", 60)], "g string, x int")
    text = """
[stage.large]
verb = "compare"
field = "x"
op = ">"
to = 55
[stage.found]
verb = "join"
input = "input"
right = "large"
on = [["g", "g"]]
[stage.rest]
verb = "join"
input = "input"
right = "large"
on = [["g", "g"]]
kind = "anti"
"""
    assert [tuple(r) for r in pipelines.run(text, df).collect()] == [("a", 5)]
    with pytest.raises(ValueError):
        pipelines.stages('[stage.x]\nverb = "union"\nright = "later"\n')


def test_leaders_keep_rows_that_repeat_an_order(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vectors, "HEAD", 5)
    monkeypatch.setattr(vectors, "PARTS", 3)
    rng = np.random.default_rng(0)
    data = [(i // 2 if i % 13 else None, rng.normal(size=3).tolist()) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(data, "id int, v array<double>")
    got = [(r.id, r.leader) for r in vectors.leaders(df, "id", "v", 0.8).collect()]
    unit = [(i, np.array(v) / np.linalg.norm(v), v) for i, v in data if v]
    chosen, want = [], [(99, 99)]
    for i, u, _ in sorted(unit, key=lambda x: (x[0] is not None, x[0] or 0, x[2])):
        near = [j for j, w in chosen if w @ u >= 0.8 - 1e-12]
        if not near:
            chosen.append((i, u))
        want.append((i, near[0] if near else i))
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_adaptive_threshold_strides_over_all_pairs(spark):
    import numpy as np

    v = np.random.default_rng(1).normal(size=(40, 4))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([x for i, x in enumerate(v) for x in ([(i, x.tolist())] + [(i, None)] * (i % 3))], "id int, v array<double>")
    pairs = [(i, j) for i in range(40) for j in range(i + 1, 40)]
    for budget in (20_000, 100):
        some = pairs[:: len(pairs) // budget + 1] if len(pairs) > budget else pairs
        cosines = sorted(float(unit[i] @ unit[j]) for i, j in some)
        median = cosines[len(cosines) // 2]
        want = median + 0.35 * (cosines[min(len(cosines) - 1, int(0.95 * len(cosines)))] - median)
        assert abs(vectors.adaptive_threshold(df, "id", "v", budget) - want) < 1e-9


def test_rows_without_an_answer(spark):
    df = spark.createDataFrame([(1, "yes"), (2, "no"), (3, "bad")], "id int, t string")

    class Model(semantic.ChatModel):
        def complete(self, prompts):
            return [None if p == "bad" else p for p in prompts]

    assert [r.id for r in semantic.filter_rows(df, "{t}", Model()).collect()] == [1]
    assert [r.id for r in semantic.filter_rows(df, "{t}", Model(), invert=True).collect()] == [2]
    old = spark.createDataFrame([("a", '{"n": 5}'), ("b", "nothing")], "n string, t string")

    class Echo(semantic.ChatModel):
        def complete(self, prompts):
            return prompts

    assert sorted(r.n for r in semantic.extend_rows(old, "{t}", Echo(), "n string").collect()) == ["5", "b"]


def test_percentiles_by_window_and_by_ranges(spark, monkeypatch):
    import random

    rng = random.Random(4)
    data = [(rng.choice("ab"), rng.choice([None, *map(float, range(50))]), rng.choice([0.0, -1.5, 7.0])) for _ in range(500)] + [("c", None, 1.0)]
    df = spark.createDataFrame(data, "g string, x double, y double")
    fields = {"x": {"p50": 0.5, "p99": 0.99}, "y": {"p90": 0.9}}
    plain = tables.percentiles(df, ["g"], fields).collect()
    monkeypatch.setattr(tables, "WINDOW_ROWS", 0)
    assert sorted(plain) == sorted(tables.percentiles(df, ["g"], fields).collect())
    rank = lambda vs, q: sorted(vs)[round(q * (len(vs) - 1))] if vs else None
    for r in plain:
        xs, ys = [x for g, x, _ in data if g == r.g and x is not None], [y for g, _, y in data if g == r.g]
        assert (r.p50_x, r.p99_x, r.p90_y) == (rank(xs, 0.5), rank(xs, 0.99), rank(ys, 0.9))

"""Prompts, payloads, answers with record schemas, pipelines that ask models, documents, sorting of mixed values, near
groups, agreement by order, profiles with examples."""

import json

import pytest
from pyspark.sql import functions as F

from korvane.functions import texts
from korvane.functions.schemas import record_schema
from korvane.operators import rows, semantic, tables, vectors
from korvane.plans import pipelines
from korvane.sources import readers, writers


def test_prompts_and_payloads(spark):
    df = spark.createDataFrame([("a & <b>\nc", {"n": "Ann"}, [1, 2], None)], "t string, u map<string, string>, l array<int>, z string").withColumn("__m", F.lit("hidden"))
    one = lambda c: df.select(c.alias("c")).first().c
    assert one(semantic.prompt("{t}|{u.n}|{l[1]}|{l}|{z}|{{x}}|{ y }", df)) == "a & <b>\nc|Ann|2|[1,2]||{x}|{ y }"
    with pytest.raises(ValueError, match="names 'none'"):
        semantic.prompt("{none}", df)
    assert one(semantic.payload(df)) == '<input>\nt: a &amp; &lt;b&gt;\n  c\nu: {"n":"Ann"}\nl: [1,2]\n</input>'
    assert df.select(F.col("t").alias("text")).select(semantic.payload(df.select(F.col("t").alias("text"))).alias("c")).first().c == "<input>\na &amp; &lt;b&gt;\nc\n</input>"


def test_record_schema_of_answers(spark):
    answers = {"1": '{"n": "7", "tag": "x", "more": 1}', "2": '```json\n{"n": 2.5, "tag": "y"}\n```', "3": "junk"}
    df = spark.createDataFrame([(i, f"old{i}") for i in answers], "i string, n string")
    model = semantic.RuleChat(answers.get)
    schema = record_schema({"n": "integer", "tag": {"enum": ["x", "y"]}})
    got = {r["__error"]: (r.n, r.tag) for r in semantic.map_rows(df, "{i}", model, schema, keep_invalid=True).collect()}
    assert got == {None: (7, "x"), "record.n: is not a whole number": (None, None), "no JSON in the answer": (None, None)}
    assert {r.i: (r.n, r.tag) for r in semantic.extend_rows(df, "{i}", model, schema).collect()} == {"1": ("7", "x"), "2": ("old2", None), "3": ("old3", None)}
    assert {r.i: r.n for r in semantic.extend_rows(df, "{i}", model, "n string").collect()} == {"1": "7", "2": "2.5", "3": "old3"}
    assert {r.i: r.n for r in semantic.extend_rows(df, "{i}", model, "n int").collect()}["3"] == "old3"


PIPELINE = """
[stage.warm]
verb = "compare"
field = "v"
op = ">"
to = 1

[stage.typed]
verb = "extend"
prompt = "size {t}"
model = "rules"
schema = { size = "integer", kind = { enum = ["long", "short"] } }

[stage.long]
verb = "filter"
prompt = "is {kind} long?"
model = "rules"

[stage.sum]
verb = "reduce"
text = "size"
order = "v"
prompt = "{items}"
model = "sums"
budget = 2
by = ["kind"]
"""


def _rules(p):
    if p.startswith("size "):
        n = len(p) - 5
        return json.dumps({"size": n, "kind": "long" if n > 3 else "short"})
    return "yes" if "long long" in p else "no"


def test_pipelines_ask_models(spark):
    df = spark.createDataFrame([(i, "x" * i) for i in range(12)], "v int, t string")
    models = {"rules": semantic.RuleChat(_rules), "sums": semantic.RuleChat(lambda p: str(sum(map(int, p.split()))))}
    text = PIPELINE.replace('text = "size"', 'text = "size_text"').replace('[stage.sum]', '[stage.text]\nverb = "as_text"\n\n[stage.sum]')
    pipelines.register("as_text", lambda df: df.withColumn("size_text", F.col("size").cast("string")))
    assert [(r.kind, r.result, r.rows) for r in pipelines.run(text, df, models).collect()] == [("long", str(sum(range(4, 12))), 8)]
    assert pipelines.requests(text, df)[0] == ("typed", "extend", "size ")
    with pytest.raises(ValueError, match="no model 'sums'; there are rules"):
        pipelines.run(text, df, {"rules": models["rules"]})
    for change, complaint in ((('to = 1', 'too = 1'), "stage warm: compare has no option 'too'"), (('op = ">"\n', ""), "stage warm: compare needs 'op'"), (('verb = "filter"', 'verb = "sieve"'), "no verb 'sieve'"), (('verb = "filter"\n', ""), "stage long: no verb")):
        with pytest.raises(ValueError, match=complaint):
            pipelines.stages(PIPELINE.replace(*change))


PAGE = """<!DOCTYPE html><html><head><title>No</title></head><!-- > no --><body class='a>b'><p title="x>y">One &eacute;&#8212;&#x41; &lt;b&gt; 1 < 2</p>
<script type="text/javascript">if (a < b) { "</p>" }</script><div>Two<br/>three&nbsp; &copy four</div><custom-tag a=1>five</custom-tag><style>p{}</style><p>six<script>never ends"""


def test_html(spark, tmp_path):
    df = spark.createDataFrame([(PAGE,), (None,), ("",), ("plain & simple",), ("<p>a</p><p></p>\n\n<p>b</p>",)], "h string")
    got = [r[0] for r in df.select(texts.html_text(F.col("h"))).collect()]
    assert got == ["One é—A <b> 1 < 2\nTwo\nthree © four\nfive\nsix", "", "", "plain & simple", "a\nb"]
    (tmp_path / "a.html").write_text(PAGE)
    (tmp_path / "b.txt").write_bytes(b"x\r\ny\xff")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    got = {r["__source"].rsplit("/", 1)[-1]: (r.text, r.kind, r.unread) for r in readers.read(spark, [str(tmp_path)], "file").collect()}
    assert got["a.html"][0].startswith("One é") and got["b.txt"] == ("x\ny�", "text", False) and got["c.pdf"] == (None, "pdf", True)
    (tmp_path / "d.jsonl").write_text('{"a": 1}\n')
    assert readers.read(spark, [str(tmp_path / "d.jsonl")]).count() == 1
    with pytest.raises(ValueError, match="call for"):
        readers.read(spark, ["a.csv", "b.jsonl"])
    with pytest.raises(ValueError, match="not 'pages'"):
        readers.read(spark, ["a.csv"], "pages")


def test_sort_of_mixed_json(spark):
    values = ['"b"', "10", "9.5", "null", '"B"', "true", '"10"', None, "[1]"]
    df = spark.createDataFrame([(i, f'{{"k": {v}}}' if v else "{}") for i, v in enumerate(values)], "i int, j string").repartition(3)
    order = lambda desc: [r.i for r in rows.sort_json(df, "j", "k", desc, ["i"]).collect()]
    assert order(False) == [2, 1, 6, 4, 0, 8, 5, 3, 7]
    assert order(True) == [1, 2, 0, 4, 6, 5, 8, 3, 7]
    times = spark.createDataFrame([(1, '{"k": "2026-01-02"}'), (2, '{"k": "2026-01-01T23:00:00Z"}'), (3, "{}")], "i int, j string")
    assert [r.i for r in rows.sort_json(times, "j", "k").collect()] == [2, 1, 3]


def test_near_groups(spark):
    data = [(1, " a", [1.0, 0.0]), (2, "b", [0.99, 0.01]), (3, "a", [0.0, 1.0]), (4, "b ", [5.0, 5.0]), (5, "c", [0.0, 1.0]), (6, None, None), (7, None, [0.0, 2.0]), (8, "d", None)]
    df = spark.createDataFrame(data, "o int, t string, v array<double>")
    assert {r.o for r in vectors.distinct_near(df, "o", "v", 0.9, "t").collect()} == {1, 5, 6, 8}
    got = {r.kept: (r["count"], r.duplicates) for r in vectors.distinct_near_groups(df, "o", "v", 0.9, "t").collect()}
    assert got == {1: (4, [2, 3, 4]), 5: (2, [7]), 6: (1, []), 8: (1, [])}
    assert {r.o for r in vectors.distinct_near(df, "o", "v", 0.9).collect()} == {1, 3, 4, 6, 8}


def test_agreement_by_order_and_sides(spark):
    a = spark.createDataFrame([(3, "x"), (1, "y"), (2, None)], "k int, label string")
    b = spark.createDataFrame([(10, "y"), (20, "x"), (30, "z")], "k int, label string")
    assert {tuple(r) for r in tables.agreement_by_order(a, b, ["k"]).collect()} == {("y", "y", 1), ("x", "z", 1)}
    with pytest.raises(ValueError, match="3 rows on one side and 2"):
        tables.agreement_by_order(a, b.limit(2), ["k"])
    c = spark.createDataFrame([(3, "x"), (None, "x"), (None, "y"), (9, "q")], "k int, label string")
    assert tables.agreement_sides(a, c, "k").first().asDict() == {"both": 1, "a_only": 2, "b_only": 3}
    assert [tuple(r) for r in tables.agreement(a, c, "k").collect()] == [("x", "x", 1)]


def test_profile_with_examples(spark):
    data = [(2, '{"z": "' + "long " * 9 + '", "a": 1}'), (1, '{"z": null, "m": {"q": 1}}'), (3, '{"a": "s"}'), (4, "no")]
    df = spark.createDataFrame(data, "o int, j string")
    got = [(r.position, r.field, r.types, r.present, r.example) for r in tables.json_profile(df, "j", "o").orderBy("position").collect()]
    assert got == [(1, "m", "object", 1, '{"q":1}'), (2, "z", "string", 1, "long long long long lon…"), (3, "a", "integer|string", 2, "1")]


def test_rows_bring_vectors(spark):
    model = semantic.HashingEmbedder(4, "m")
    df = spark.createDataFrame([(1, "a", [1.0, 2.0, 3.0, 4.0], "m"), (2, "b", None, None), (3, None, None, None)], "i int, t string, vector array<double>, __embedder string")
    got = {r.i: (r.vector, r["__embedder"]) for r in semantic.with_vectors(df, "t", model, size=4).collect()}
    assert got == {1: ([1.0, 2.0, 3.0, 4.0], "m"), 2: (model.embed(["b"])[0], "m"), 3: (None, "m")}
    with pytest.raises(Exception, match="a vector of m does not mix with those of other"):
        semantic.with_vectors(df, "t", semantic.HashingEmbedder(4, "other")).collect()
    with pytest.raises(Exception, match="a vector of 4 components among those of 3"):
        semantic.with_vectors(df, "t", semantic.HashingEmbedder(3, "m"), size=3).collect()
    plain = semantic.with_vectors(df.drop("vector", "__embedder"), "t", model)
    assert plain.where("vector is not null").count() == 2


def test_split_rows(spark):
    df = spark.createDataFrame([("/x/a.txt", "p\n\n" * 30, 1), ("b", None, 2), ("c", "", 3), (None, "short", 4)], "path string, body string, n int")
    got = rows.split_rows(df, "body", 5, "path").collect()
    assert "".join(r.text for r in got if r.n == 1) == "p\n\n" * 30
    last = [r for r in got if r.n == 1][-1]
    assert last["__source"].label == f"a.txt §{last['__source'].segment}/{last['__source'].segment}" and last["__source"].path == "/x/a.txt"
    assert [(r.text, r["__source"].label, r["__source"]["as"]) for r in got if r.n != 1] == [("short", "row §1/1", "tokens")]


def test_recorded_runs(spark, tmp_path):
    df = spark.range(10)
    said = semantic.recorded("where", {"min": 3}, df, lambda x: x.where("id >= 3"), str(tmp_path / "out"), str(tmp_path / "run"), "p", {"chat": "m"})
    assert (said["rows_in"], said["rows_out"], said["models"]) == (10, 7, {"chat": "m"})
    assert json.loads(spark.read.text(str(tmp_path / "run")).first()[0]) == said and spark.read.parquet(str(tmp_path / "out")).count() == 7
    assert said["options_sha256"] == json.loads(semantic.manifest("where", {"min": 3}, 0, 0))["options_sha256"]


def test_label_text(spark):
    a = spark.createDataFrame([(1, True, [1, 2]), (2, False, None)], "k int, label boolean, l array<int>")
    assert {tuple(r) for r in tables.agreement(a, a, "k").collect()} == {("true", "true", 1), ("false", "false", 1)}
    assert [tuple(r) for r in tables.agreement(a, a, "k", "l").collect()] == [("[1,2]", "[1,2]", 1)]


def test_forms(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "i int, text string")
    for name, form in (("o.jsonl", "jsonl"), ("o.csv", "csv"), ("o.TSV", "tsv"), ("plain", "jsonl"), ("o.parquet", "parquet")):
        assert writers.write(df, str(tmp_path / name)) == form
    assert writers.write(df.select("text"), str(tmp_path / "lines")) == "text" and (spark.read.text(str(tmp_path / "lines")).first()[0]) == "a"
    assert spark.read.csv(str(tmp_path / "o.TSV"), sep="\t", header=True).first().text == "a"
    for frame, form in ((df, "text"), (df.select("text"), "csv"), (df, "xml")):
        with pytest.raises(ValueError):
            writers.write(frame, str(tmp_path / "bad"), form)


def test_unmatched_rows_are_kept(spark, tmp_path):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, t string")
    right = spark.createDataFrame([(1, "x")], "k int, u string")
    got = rows.join_keeping_unmatched(left, right, [("k", "k")], str(tmp_path / "u")).collect()
    assert [(r.left.t, r.right.u) for r in got] == [("a", "x")]
    assert {r.t for r in spark.read.json(str(tmp_path / "u")).collect()} == {"b", "c"}

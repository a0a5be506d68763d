"""Archives, search and chat, against brute force and on odd rows; the pipeline against its stages' brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from korvane.llm import chat, simhash, topk, warc
from tests.llm.test_documents import brute_groups, keyed

PAGES = [(1, "http://a.Example.com/x?q=1", "<p>same</p>"), (2, "https://b.example.com:8080/", "<p>same</p>"), (3, None, None), (4, "", ""), (5, "not a url\n\t", "é漢\x00"), (5, "http://x/", "é漢\x00"), (None, "http://a.example.com/x?q=1", "alone"), (6, "http://[bad", "<p>same</p>"), (7, "http://x/" + "y" * 5000, "z" * 200_000)]


def test_archive(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "row": F.lit("r"), "file": F.lit(None)})
    path = warc.new_path(spark, "warc")
    captures = warc.write_archives(pages, path)
    directory = warc.write_index(captures, path)
    got = warc.read_records(warc.find_captures(pages, directory, path), path, payload=True).collect()
    assert len(got) == len(PAGES)
    groups = {}
    for page_id, _, html in PAGES:
        groups.setdefault((html or "").encode(), []).append(page_id)
    for payload, ids in groups.items():
        mine = [r for r in got if r.payload_digest == warc.digest32(payload)]
        assert keyed(r.page_id for r in mine) == keyed(ids) and {r.payload_bytes for r in mine} == {len(payload)}
        response = [r for r in mine if r.record_type == "response"]
        assert len(response) == 1 and response[0].page_id == max((i for i in ids if i is not None), default=None) and response[0].payload == payload
        assert all(r.refers_to == response[0].page_id for r in mine if r.record_type == "revisit")
    assert {r.page_id for r in warc.lookup(directory, path, ["HTTP://A.example.com/x?q=1"]).collect()} == {1, None}
    assert warc.lookup(directory, path, ["http://none/"]).count() == 0
    assert warc.url_key("http://www.Example.com:80/A?b") == "com,example,www)/a?b"
    none = warc.write_archives(pages.limit(0), path + "0")
    assert warc.read_records(warc.find_captures(pages, warc.write_index(none, path + "0"), path + "0"), path + "0").count() == 0


def test_find_captures(spark, monkeypatch):
    rows = [(i // 2 if i % 7 else None, f"http://h/{i % 5 if i > 200 else 0}", f"p{i % 50}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.new_path(spark, "warc")
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    directory = warc.write_index(warc.write_archives(pages, path), path)
    some = [(None, "http://h/0"), (3, "http://H/0"), (3, "http://h/0"), (3, "http://h/4"), (150, f"http://h/{300 % 5}"), (10**9, "http://zz/")]
    got = warc.read_records(warc.find_captures(spark.createDataFrame(some, "page_id long, url string"), directory, path), path)
    asked = {(p, u.lower()) for p, u in some}
    assert keyed((r.page_id, r.url) for r in got.collect()) == keyed((p, u) for p, u, _ in rows if (p, u) in asked)
    assert warc.read_records(warc.find_captures(pages, directory, path), path).count() == len(rows)


def test_record_ids(spark):
    import zlib

    ids = []
    for n, place in enumerate(["", ":a:0", ":a:9"]):
        raw = zlib.decompress(warc.record(5, "u", b"x", warc.digest32(b"x"), "5" if n else None, place), 31)
        ids += [line for line in raw.split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
        assert warc.parse(warc.record(5, "u", b"x", warc.digest32(b"x"), "5" if n else None, place))["refers_to"] == (5 if n else None)
    assert len(set(ids)) == 3


def test_lookup_across_blocks(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h/{i % 5}", f"p{i}") for i in range(60)], "page_id long, url string, html string").coalesce(1)
    path = warc.new_path(spark, "warc")
    captures = warc.write_archives(pages, path)
    directory = warc.write_index(captures, path)
    assert {r.page_id for r in warc.lookup(directory, path, ["http://h/3", "http://h/0"]).collect()} == {i for i in range(60) if i % 5 in (0, 3)}


@pytest.mark.parametrize("seed", [0, 1])
def test_topk_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "SHARD", 100)
    monkeypatch.setattr(topk, "QUERY_CHUNK", 4)
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, 5))
    v = np.floor(1024 * (centers[rng.integers(0, 6, 900)] + 0.1 * rng.normal(size=(900, 5)))).astype(int)
    v[100:140] = v[100]  # ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<long>")
    want = set()
    for q in range(0, 900, 100):
        best = sorted((-int(v[q] @ v[c]), c) for c in range(900) if c != q)[:10]
        want |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(best)}
    assert {tuple(r) for r in topk.search(df).collect()} == want


@pytest.mark.parametrize("n", [1, 2, 40, 400])
def test_cover_tree(n):
    rng = np.random.default_rng(n)
    points = np.floor(1000 * rng.normal(size=(n, 3)) * rng.choice([0.01, 1, 30], size=(n, 1))).astype(int)
    points[n // 2 :] = points[: n - n // 2]  # repeated rows
    apart = lambda i, j: float(np.linalg.norm(points[i] - points[j]))
    nets = {}

    def walk(node):
        nets.setdefault(node.level, set()).add(node.at)
        assert max(apart(node.at, m) for m in node.members) == pytest.approx(node.radius)
        if node.children:
            assert node.children[0].at == node.at  # nesting
            assert sorted(node.members) == sorted(m for c in node.children for m in c.members)
            for c in node.children:
                assert c.level < node.level and apart(c.at, node.at) <= 2.0 ** (c.level + 1)  # covering
                walk(c)

    root = topk.cover_tree(points, max(n // 4, 1))
    assert sorted(root.members) == list(range(n))
    walk(root)
    for level, here in nets.items():
        assert all(apart(i, j) >= 2.0**level for i in here for j in here if i != j)  # separation


def test_topk_prunes():
    rng = np.random.default_rng(5)
    v = np.floor(1024 * (np.repeat(4 * rng.normal(size=(8, 4)), 50, 0) + 0.05 * rng.normal(size=(400, 4)))).astype(int)
    ids, (chosen, _, node, far) = np.arange(400), topk.net(v, 8)
    floor = topk.first_floor(v, ids, v, ids, 3)
    met = topk.met_nodes(v, floor, v[chosen], {i: float(far[node == i].max()) for i in range(8)})
    scores = v @ v.T
    np.fill_diagonal(scores, -(1 << 62))
    assert all(set(node[scores[i] >= floor[i]]) <= set(met[i].tolist()) for i in range(400))  # nothing is lost
    assert sum(map(len, met)) < 400 * 8 / 2


def test_topk_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 2.0]), (1, [0.5, None]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (None, [9.0, 9.0]), (6, []), (7, [3.0]), (100, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").where(topk.valid(F.col("embedding")))
    got = [tuple(r) for r in topk.search(df.select("vec_id", topk.scaled(F.col("embedding")).alias("v"))).orderBy("query_id", "rank").collect()]
    m = 1024 * 1024
    assert [g for g in got if g[0] == 0] == [(0, 1, 5, 5 * m), (0, 2, 5, 5 * m), (0, 3, 7, 3 * m), (0, 4, 100, 3 * m), (0, 5, 6, 0)]
    assert topk.search(df.limit(0).select("vec_id", topk.scaled(F.col("embedding")).alias("v"))).count() == 0
    assert topk.search(df.where("vec_id = 5").select("vec_id", topk.scaled(F.col("embedding")).alias("v"))).count() == 0
    assert topk.products(np.array([[2**30, 1]]), np.array([[2**30, 1]])).tolist() == [[2**60 + 1]]


EVENTS = [
    (1, 0, "a", "open", "user", "h\\<i"), (1, 1, "b", "open", "assistant", "x"), (1, 2, "b", "delta", None, "y"), (1, 3, "c", "open", "user", "later"), (1, 4, "b", "regenerate", None, "zzz"),
    (1, 5, "b", "delta", None, "N<"), (1, 6, "b", "delta", None, "ew"), (1, 7, "a", "edit", None, "hello\\\\l"), (1, 8, "d", "open", "user", "bye"), (1, 9, "d", "delete", None, None),
    (None, 0, "m", "open", None, None), (2, 0, "m", "delta", "assistant", "no opening"),
]


def test_chat_events(spark):
    events = spark.createDataFrame(EVENTS, "conv_id long, seq long, msg string, kind string, role string, text string")
    out = {r.conv_id: r for r in chat.format_events(events).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    assert [(t.role, t.text, t.loss) for t in out[1].turns] == [("user", "hello\\\\l", False), ("assistant", "N<ew", True)]
    assert [(t.role, t.text) for t in out[None].turns] == [("", "")]
    assert [(t.role, t.text) for t in out[2].turns] == [("assistant", "no opening")]
    assert [out[1].formatted[s.start : s.start + s.length] for s in out[1].loss_spans] == ["N\\lew"]
    assert chat.format_events(events.limit(0)).count() == 0


def test_chat_round_trip(spark):
    texts = ["", "\\", "\\\\", "\\l", "<", "\\<", "<turn>", "</turn>\n", "<turn loss>assistant\n", "\\\\l\\", "a\nb", "漢🙂", "\\n", "漢🙂<" * 500, "0123456789" * 100_000]
    rows = [(1, i, ["user", "assistant", "a\\\nb<"][i % 3], t) for i, t in enumerate(texts * 12)] + [(2, 0, None, None), (2, 0, None, None), (2, None, "user", "first"), (None, 1, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit(1), "msg": F.lit("m"), "kind": F.lit("delete"), "place": F.lit(0)})
    kinds = {r[0] for r in chat.events_of(df).select("kind").distinct().collect()}
    assert kinds == {"open", "edit", "delta", "regenerate"}
    out = {r.conv_id: r for r in chat.format_events(chat.events_of(df)).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [(r[2], r[3]) for r in rows if r[0] == 1]
    assert [(t.role, t.text) for t in out[2].turns] == [("user", "first"), ("", ""), ("", "")]
    for o in out.values():
        assert [o.formatted[s.start : s.start + s.length] for s in o.loss_spans] == [t.text.replace("\\", "\\\\").replace("<", "\\l") for t in o.turns if t.loss]


def test_pipeline(spark, sf):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from korvane.llm import _common, classifier, mixing, rules

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{sf}/labels.parquet")
    kept, stages = [], {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, _common.materialize(stage(spark, docs, sf), "t")
        kept.append(docs.count())
        stages[name] = before
    assert kept[0] >= kept[1] >= kept[2] > 0 and all(stages[n].columns == columns for n, _ in corpus_pipeline.STAGES)
    # Deduplication, against all pairs of five-word similarity 0.8 or more.
    rows = stages["simhash near-dedup"].collect()
    left = stages["mix sources"].collect()
    assert keyed(r.doc_id for r in left) == keyed(set(brute_groups([r.text for r in rows], [r.doc_id for r in rows])))
    # The classifier's and the rules' verdicts take effect.
    want = classifier.Classifier(stages["quality classifier"], labels, []).verdicts().where("_q_kept").select("_q_all.doc_id").collect()
    assert keyed(r.doc_id for r in want) == keyed(r.doc_id for r in stages["quality rules"].collect())
    stats = rules.with_stats(stages["quality rules"], ["doc_id", "lang"])
    want = rules.judge(stats, rules.cutoffs(stats, labels)).where("_r_kept").select("doc_id").collect()
    assert keyed(r.doc_id for r in want) == keyed(r.doc_id for r in rows)
    assert docs.count() == mixing.plan(mixing.numbered_rows(stages["mix sources"])).agg(F.sum("times")).first()[0]
    assert docs.where("not round_trip or round_trip is null").count() == 0
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_digests():
    assert hashlib.sha1(b"").digest() == __import__("base64").b32decode(warc.digest32(b""))
    assert simhash.blocks_for(10, 4) >= 5

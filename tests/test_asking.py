"""Answers that outlive a run, budgets, long inputs and the tree of notes, with models that count what they are asked."""

import re
import threading
import time
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from korvane.functions.texts import chunks_of, tokens_of
from korvane.operators import asking, reducing, semantic


def logged(path, rule):
    """A model that writes down what it is asked, a line for each prompt."""

    def answer(prompt):
        with open(path, "a") as f:
            f.write(f"{prompt!r}\n")
        return rule(prompt)

    return semantic.RuleChat(answer)


def asked(path):
    try:
        return [eval(line) for line in open(path)]
    except FileNotFoundError:
        return []


@dataclass
class Windowed(semantic.ChatModel):
    """Refuses prompts of more than ``window`` tokens."""

    inner: semantic.ChatModel
    window: int

    def complete(self, prompts):
        if any(tokens_of(p) > self.window for p in prompts):
            raise asking.Overflow
        return self.inner.complete(prompts)


def test_second_run_asks_nothing(spark, tmp_path):
    rows = [(i, None if i % 10 == 9 else f"q{i % 7}") for i in range(100)]
    df = spark.createDataFrame(rows, "i long, q string").repartition(5)
    cache, log = asking.AnswerCache(spark, str(tmp_path / "cache")), str(tmp_path / "log")
    model = logged(log, lambda p: None if p == "q3" else p.upper())
    out, usage = asking.ask_cached(df, F.col("q"), model, cache, "m", waves=3)
    assert {(r.i, r["_answer"]) for r in out.collect()} == {(i, None if q in (None, "q3") else q.upper()) for i, q in rows}
    failed = sum(q == "q3" for _, q in rows)
    assert usage.first().asDict() == {"requests": 90, "distinct": 7, "hits": 0, "asked": 7, "unanswered": failed}
    assert sorted(asked(log)) == [f"q{i}" for i in range(7)]
    again, usage = asking.ask_cached(df, F.col("q"), model, cache, "m")
    assert sorted(again.collect(), key=repr) == sorted(out.collect(), key=repr)
    assert usage.first().asDict() == {"requests": 90, "distinct": 7, "hits": 6, "asked": 1, "unanswered": failed}
    assert sorted(asked(log)) == sorted([f"q{i}" for i in range(7)] + ["q3"])
    _, other = asking.ask_cached(df, F.col("q"), model, cache, "another model")
    assert other.first().hits == 0


def test_budget_counts_distinct_requests(spark, tmp_path):
    df = spark.createDataFrame([(i, f"q{i // 4}") for i in range(40)], "i long, q string")
    cache, log = asking.AnswerCache(spark, str(tmp_path / "cache")), str(tmp_path / "log")
    model = logged(log, str.upper)
    out, usage = asking.ask_cached(df, F.col("q"), model, cache, "m", max_calls=3, order="i")
    assert {r.i for r in out.where("_answer is not null").collect()} == set(range(12))
    assert usage.first().asDict() == {"requests": 40, "distinct": 10, "hits": 0, "asked": 3, "unanswered": 28}
    _, usage = asking.ask_cached(df, F.col("q"), model, cache, "m", max_calls=100, order="i")
    assert usage.first().asDict() == {"requests": 40, "distinct": 10, "hits": 3, "asked": 7, "unanswered": 0}
    assert len(asked(log)) == 10
    none, usage = asking.ask_cached(df.limit(0), F.col("q"), model, cache, "m")
    assert none.count() == 0 and usage.first().asked == 0


def test_pool_keeps_order_and_window():
    lock, now, most = threading.Lock(), [0], [0]

    def slow(p):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02 if int(p) % 3 else 0.05)
        with lock:
            now[0] -= 1
        return p + "!"

    assert asking.Pooled(semantic.RuleChat(slow), width=4).complete([str(i) for i in range(30)]) == [f"{i}!" for i in range(30)]
    assert 2 <= most[0] <= 4


def test_pool_breaks_and_replays():
    calls = []

    def dying(p):
        calls.append(p)
        if int(p) >= 10:
            raise RuntimeError("down")
        return "first"

    def second(p):
        if p == "12":
            raise RuntimeError("no")
        return "second"

    pool = asking.Pooled(semantic.RuleChat(dying), width=2, second=semantic.RuleChat(second), breaks=3)
    got = pool.complete([str(i) for i in range(40)])
    assert got == ["first"] * 10 + [None if i == 12 else "second" for i in range(10, 40)]
    assert pool.broken and len(calls) <= 10 + 3 + 2
    assert pool.complete(["1"]) == ["second"]
    alone = asking.Pooled(semantic.RuleChat(lambda p: 1 / 0), width=2, breaks=9)
    assert alone.complete(["1", "2"]) == [None, None]


TEXTS = [(1, "yes here " + "x" * 400), (2, "a" * 300 + " yes " + "b" * 300), (3, "c" * 900), (4, "short yes"), (5, None), (6, ""), (7, "d" * 95)]


@pytest.mark.parametrize("window", [10**6, 20])
def test_judge_long(spark, tmp_path, window):
    """Verdicts are those of the whole text; no chunk after the first yes is asked."""
    log = str(tmp_path / "log")
    model = Windowed(logged(log, lambda p: "yes" if "yes" in p else "no"), window)
    df = spark.createDataFrame(TEXTS, "i long, t string").coalesce(1)
    got = {r.i: (r["_match"], r["_asked"]) for r in asking.judge_long(df, "t", "{i}:{t}", model, 25).collect()}
    assert {i: m for i, (m, _) in got.items()} == {i: None if t is None else "yes" in t for i, t in TEXTS}
    for i, t in TEXTS:
        chunks = chunks_of(t, 25) if t else [""] * (t is not None)
        first = next((k for k, c in enumerate(chunks, 1) if "yes" in c), len(chunks))
        assert got[i][1] == first
    if window > 100:
        assert len(asked(log)) == sum(n for _, n in got.values())


def test_map_long(spark, tmp_path):
    log = str(tmp_path / "log")

    def rule(p):
        if p.startswith("merge"):
            return str(sum(int(x) for x in re.findall(r"\d+", p)))
        return str(p.count("z"))

    df = spark.createDataFrame([(1, "z" * 900), (2, "zz"), (3, None), (4, "az\n" * 500)], "i long, t string")
    out = asking.map_long(df, "t", "{t}", "merge {items}", Windowed(logged(log, rule), 60), 50)
    assert {r.i: r.result for r in out.collect()} == {1: "900", 2: "2", 3: None, 4: "500"}
    fields = asking.map_long(df, "t", "{t}", "merge {items}", semantic.RuleChat(lambda p: '{"n": %s}' % rule(p)), 50, "n long", keep_invalid=True)
    assert {r.i: (r.n, r["__invalid"]) for r in fields.collect()} == {1: (900, False), 2: (2, False), 3: (None, True), 4: (500, False)}


def tree(texts, budget):
    """How many questions the sequential rule asks for one group whose notes are numbers."""
    asked, sizes = 0, [tokens_of(t) for t in texts]
    values = [int(t.split()[0]) for t in texts]
    while sum(sizes) > budget and len(sizes) > 1:
        chunks, used = [], None
        for s, v in zip(sizes, values):
            if used is None or used + s > budget:
                chunks.append([])
                used = 0
            chunks[-1].append(v)
            used += s
        asked += len(chunks)
        values = [sum(c) for c in chunks]
        sizes = [tokens_of(str(v)) for v in values]
    return asked + 1


def test_reduce_packed(spark, tmp_path):
    """Sums of numbers in long texts: every row counts once, and as many questions as the sequential rule needs."""
    log = str(tmp_path / "log")

    def rule(p):
        return str(sum(int(x.split()[0]) for x in p.split("\n")))

    rows = [("hot", i, f"{i} " + "x" * (i % 50)) for i in range(600)] + [("b", i, str(i)) for i in range(3)] + [("c", 1, "5"), (None, 1, "9"), ("d", 1, None)]
    df = spark.createDataFrame(rows, "g string, o long, t string").repartition(6)
    out = reducing.reduce_packed(df, "t", "o", "{items}", "{items}", logged(log, rule), 60, ["g"])
    assert {(r.g, r.result, r.rows, r.lost) for r in out.collect()} == {("hot", str(sum(range(600))), 600, 0), ("b", "3", 3, 0), ("c", "5", 1, 0)}
    assert len(asked(log)) == tree([t for g, _, t in rows if g == "hot"], 60) + 2
    whole = reducing.reduce_packed(df.where("g = 'hot'"), "t", "o", "{items}", "{items}", semantic.RuleChat(rule), 60).collect()
    assert [(r.result, r.rows) for r in whole] == [(str(sum(range(600))), 600)]
    assert reducing.reduce_packed(df.limit(0), "t", "o", "{items}", "{items}", semantic.RuleChat(rule), 60).count() == 0


def test_reduce_halves_and_loses(spark):
    def rule(p):
        if "13" in p.split():
            return None
        return str(sum(int(x) for x in p.split()))

    rows = [("a", i, str(i)) for i in range(1, 11)] + [("bad", 1, "13"), ("long", 1, "1 " * 200)]
    df = spark.createDataFrame(rows, "g string, o long, t string").coalesce(1)
    out = reducing.reduce_packed(df, "t", "o", "{items}", "{items}", Windowed(semantic.RuleChat(rule), 5), 50, ["g"])
    got = {r.g: (r.result, r.rows, r.lost) for r in out.collect()}
    assert got["a"] == ("55", 10, 0) and got["bad"] == (None, 1, 1) and got["long"][1] == 1


def test_workers_hold_a_piece_of_a_batch(spark):
    """Texts of one large Arrow batch are asked some bytes at a time, and each row keeps its own answer."""
    import pyarrow as pa

    from korvane import shared

    batch = pa.RecordBatch.from_pydict({"k": list(range(7)), "t": ["x" * 900_000, None, "y" * 3_000_000, "", "z" * 900_000, "z" * 900_000, "z" * 900_000]})
    assert [p.column("k").to_pylist() for p in shared.pieces([batch, batch.slice(0, 0)], "t")] == [[0, 1], [2], [3, 4, 5], [6], []]
    df = spark.createDataFrame([(i, "ab" * (i * 9000), None if i % 3 else i) for i in range(60)], "k long, t string, n long").coalesce(1)

    @dataclass
    class Sizes(semantic.ChatModel):
        def complete(self, prompts):
            return [f"{len(p)} of {sum(map(len, prompts))}" for p in prompts]

    got = semantic.ask(df, F.col("t"), Sizes()).collect()
    assert all(int(r["_answer"].split(" of ")[0]) == 18000 * r.k and int(r["_answer"].split(" of ")[1]) <= 2 << 20 for r in got) and len(got) == 60
    for r in asking.map_long(df, "t", "{n}:{t}", "{items}", semantic.RuleChat(lambda p: p.split(":")[0] or "none"), 10**6).collect():
        assert r.result == ("none" if r.n is None else str(r.n))

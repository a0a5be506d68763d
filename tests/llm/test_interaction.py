"""The filter audit against a document by document count."""

import itertools
import random
import re

from pyspark.sql import functions as F

from korvane.llm import interaction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["part", "filter_order", "step", *interaction.MEASURES]


def fails(rows):
    """The set of filters that each (doc_id, text) fails."""
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = WORD.findall(text)
        bad = set()
        bad |= {"A"} if len(words) < 50 else set()
        bad |= {"B"} if 100 * len(set(words)) < 65 * len(words) else set()
        bad |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else set()
        bad |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        bad |= {"E"} if doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t in rows) else set()
        out.append(bad)
    return out


def brute(docs, labels):
    """All rows of the audit of docs (doc_id, text, source), by walking every document through every order."""
    good, toxic = ({d for d, *marks in labels if marks[i] == 1 and d is not None} for i in (0, 1))
    failed = fails([(d, t) for d, t, _ in docs])
    out = []
    for part in {s or "" for _, _, s in docs}:
        mine = [(d, f) for (d, _, s), f in zip(docs, failed) if (s or "") == part]
        rows, total = [], dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            alive = mine
            for step, x in enumerate(order, 1):
                here, gone = [m for m in alive if x in m[1]], [m for m in mine if x in m[1]]
                alive = [m for m in alive if x not in m[1]]
                total[x] += len(here)
                row = [part, "".join(order), step, len(alive), len(here), len(gone) - len(here), sum(m[1] == {x} for m in mine), sum(m[0] in good for m in here), sum(m[0] in toxic for m in here)]
                rows.append((x, row))
        out += [tuple([*row, total[x]]) for x, row in rows]
    return sorted(out)


def got(frame):
    return sorted(tuple(r) for r in frame.select(COLUMNS).collect())


def test_audit_of_odd_rows(spark, odd, labels):
    docs = [tuple(r) for r in odd.select("doc_id", "text", "source").collect()]
    marks = [tuple(r) for r in labels.collect()]
    more = odd.withColumns({"mask": F.lit("m"), "digest": F.lit(1), "part2": F.lit(None), "salt": F.lit(3), "good": F.lit(True)})
    assert got(interaction.audit(more, labels)) == brute(docs, marks)
    assert got(interaction.audit(odd, labels.limit(0))) == brute(docs, [])


def test_audit_of_random_rows(spark):
    rng = random.Random(5)
    texts = [None, "", " ".join(f"w{rng.randrange(90)}" for _ in range(80)), *(" ".join(rng.choice(["a", "B", "#c", "Dd", "e"]) + str(rng.randrange(k)) for _ in range(rng.randrange(30, 70))) for k in (3, 30, 3000) for _ in range(6))]
    docs = [(rng.choice([None, *range(60)]), rng.choice(texts), rng.choice([None, "", "x", "y"])) for _ in range(150)]
    marks = [(rng.choice([None, *range(60)]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for _ in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    assert got(interaction.audit(frame, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))) == brute(docs, marks)


def test_audit_of_nothing_and_of_long_texts(spark, nothing, labels):
    assert got(interaction.audit(nothing, labels)) == []
    long = [(1, "Wort " * 400_000, "s"), (2, "w" * 1_500_000, "s"), (3, "\n".join(f"z{i}" for i in range(200_000)), None)]
    frame = spark.createDataFrame(long, "doc_id long, text string, source string")
    first = {(r.part, r.filter_order): r for r in interaction.audit(frame, labels).where("step = 5").collect()}
    assert first["s", "ABCDE"].kept == 0 and first["", "ABCDE"].kept == 1


def test_matrices():
    m = interaction.outcome_matrices()
    assert {k: v.shape for k, v in m.items()} == dict.fromkeys(m, (32, 600))
    every = m["removed"].reshape(32, 120, 5)
    assert (every.sum(axis=2)[1:] == 1).all() and (every[0] == 0).all()  # each document that fails a filter goes once
    assert (m["kept"].reshape(32, 120, 5)[:, :, 4] == [[i == 0] * 120 for i in range(32)]).all()

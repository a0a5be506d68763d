"""The n-gram join against all pairs of sets."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from korvane.llm import jaccard

SCHEMA = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))) if words else frozenset()


def brute(docs, link=(85, 100), n=4):
    """(doc_id, n_shingles, component_id) by comparing all pairs."""
    sets = [shingles(t, n) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and root[i] != root[j] and link[1] * len(sets[i] & sets[j]) >= link[0] * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = {r: min((docs[i][0] for i in range(len(docs)) if root[i] == r and docs[i][0] is not None), default=None) for r in set(root)}
    return sorted(((d, len(s), least[r]) for (d, _), s, r in zip(docs, sets, root)), key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def varied(rng, n_base, n_copies, length, edits):
    """Texts of which many are near copies of each other, chains of edits included."""
    out = []
    for b in range(n_base):
        words = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        for _ in range(n_copies):
            if rng.random() < 0.3:
                words = list(words)  # the next copies start from this one
            else:
                words = list(words)
                for _ in range(rng.randrange(edits + 1)):
                    words[rng.randrange(length)] = f"w{rng.randrange(10**6)}"
            out.append(" ".join(words))
    return out


def test_odd_rows(spark, odd, nothing):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    clash = odd.withColumns({"s1": F.lit("s"), "gram": F.lit(1), "id": F.lit(None), "t1": F.lit(2), "alone": F.lit("a")})
    assert got(jaccard.components(clash)) == brute(docs)
    assert got(jaccard.components(nothing)) == []
    assert got(jaccard.components(odd.where("text is null or trim(text) = ''"))) == brute([d for d in docs if not (d[1] or "").strip(" ")])


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "ROWS", 8)  # so that blocks are dealt out as parts
    monkeypatch.setattr(jaccard, "COLUMNS", 64)
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = varied(rng, 4, 30, 60, 3) + varied(rng, 3, 12, 8, 1) + [f"{passage} {t}" for t in varied(rng, 2, 15, 12, 2)] + ["one", "one two", "ONE two", "one  two", "", None]
    texts += rng.choices(texts, k=40)
    docs = [(rng.choice([None, *range(10**6)]), t) for t in texts]
    assert got(jaccard.components(spark.createDataFrame(docs, SCHEMA).repartition(4))) == brute(docs)


def test_other_thresholds(spark):
    rng = random.Random(9)
    docs = list(enumerate(varied(rng, 5, 12, 30, 4)))
    frame = spark.createDataFrame(docs, SCHEMA)
    for link in ((1, 2), (1, 1)):
        assert got(jaccard.components(frame, 2, link)) == brute(docs, link, 2)


def test_chains_need_blocks(spark):
    """A chain of edits whose ends don't link with the set that all of them meet first."""
    words = [f"w{i}" for i in range(100)]
    docs = []
    for k in range(40):
        docs.append((1000 - k, " ".join(words)))
        words = words[:]
        words[(7 * k) % 100] = f"x{k}"
    expected = brute(docs)
    assert len({c for _, _, c in expected}) == 1
    assert got(jaccard.components(spark.createDataFrame(docs, SCHEMA))) == expected


def test_long_texts(spark):
    base = [f"w{i % 90_000}" for i in range(300_000)]
    docs = [(3, " ".join(base)), (2, " ".join([*base, "more"])), (1, " ".join(reversed(base))), (4, "y" * 1_000_000)]
    assert {r.doc_id: r.component_id for r in jaccard.components(spark.createDataFrame(docs, SCHEMA)).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}


def test_product():
    rng = np.random.default_rng(3)
    dense = rng.random((20, 300)) < 0.2
    weights = rng.integers(1, 9, 300)
    row, cols = np.nonzero(dense)
    expected = (dense * weights) @ dense.T.astype(int)
    got = jaccard.product(cols, row, weights[cols].astype(float), 20)
    off = ~np.eye(20, dtype=bool)
    assert (got[off] == expected[off]).all()


@pytest.mark.parametrize("rows", [3, 8, 512])
def test_groups_hold_all_pairs_of_a_column(spark, monkeypatch, rows):
    monkeypatch.setattr(jaccard, "ROWS", rows)
    rng = np.random.default_rng(rows)
    columns = {c: sorted(rng.choice(range(10 * f, 10 * f + 10), rng.integers(2, 10), replace=False).tolist()) for c, f in enumerate(np.repeat(np.arange(6), 12).tolist())}
    columns |= {100: list(range(0, 60, 10)), 101: list(range(60))}
    mixed = spark.createDataFrame([(i, i, c, -c, len(ids)) for c, ids in columns.items() for i in ids], "id long, root long, x1 long, x2 long, m long")
    got = [tuple(r) for r in jaccard.gathered(mixed).select("id", "root", "x1", "x2", "m").collect()]
    groups = {}
    for i, root, x1, x2, m in got:
        assert i == root and x2 == -x1
        groups.setdefault(x1, []).append((i, m))
    assert all(len({i for i, _ in g}) == len(g) and {m for _, m in g} == {len(g)} for g in groups.values())
    assert all(any(set(ids) <= {i for i, _ in g} for g in groups.values()) for ids in columns.values())


def test_near_copies_are_sent_to_one_group(spark):
    """20 sets in each family; its columns hold 14 to 19 of them."""
    mixed = [(i, i, 1000 * f + c, 0, 19 - c % 6) for f in range(5) for c in range(40) for i in range(20 * f, 20 * f + 20) if (i + c) % 20 < 19 - c % 6]
    got = jaccard.gathered(spark.createDataFrame(mixed, "id long, root long, x1 long, x2 long, m long"))
    assert got.count() <= 2 * 100 < len(mixed) // 10


@pytest.mark.parametrize(("sent", "rows"), [(1 << 20, 1000), (200, 1000), (1 << 20, 3)])
def test_sets_with_columns_of_their_own(spark, monkeypatch, sent, rows):
    """Copies of a set in one batch and in several, columns of all sets and of few."""
    monkeypatch.setattr(jaccard, "SENT", sent)
    monkeypatch.setattr(jaccard, "SENT_ROWS", rows)
    rng = random.Random(sent + rows)
    pool = [rng.randrange(-(2**63), 2**63) for _ in range(400)]
    sets = {s: {pool[0], *rng.choices(pool, k=rng.randrange(20)), *(rng.randrange(-(2**63), 2**63) for _ in range(rng.choice([0, 2, 4, 8])))} for s in range(200)}
    held = [*sets, *rng.choices(list(sets), k=60), *[7] * 300]
    rng.shuffle(held)
    count = {}
    for grams in sets.values():
        for g in grams:
            count[g] = count.get(g, 0) + 1
    own = {s: sum(count[g] == 1 for g in grams) for s, grams in sets.items()}
    table = spark.createDataFrame([(s, -s, len(sets[s]), sorted(sets[s])) for s in held], "s1 long, s2 long, size long, grams array<long>")
    got = jaccard.common_sets(table.withColumn("id", F.monotonically_increasing_id()), sum(len(sets[s]) for s in held), (85, 100), F.count(F.lit(1)).alias("copies")).collect()
    assert {(r.s1, r.s2, r["size"], r.copies) for r in got if r.s1 != 7} == {(s, -s, len(sets[s]), held.count(s)) for s in sets if s != 7 and len(sets[s]) - own[s] >= -(-85 * len(sets[s]) // 100)}
    assert 0 < len(got) < len(sets)


def test_shuffled_bytes_of_a_column(spark):
    """Few bytes of the first block's columns are shuffled, with many partitions too."""
    rng = random.Random(4)
    docs = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(400))) for i in range(4000)]
    keyed = spark.createDataFrame(docs, SCHEMA).select("*", *[c.alias(k) for k, c in jaccard.text_key(F.col("text")).items()])
    marked = jaccard.materialize(jaccard.incidence(keyed, ["doc_id", "t1", "t2"], 4, jaccard.FIRST_BLOCK).withColumn("id", F.monotonically_increasing_id()), "marked")
    store, before = spark.sparkContext._jsc.sc().statusStore(), spark.conf.get("spark.sql.shuffle.partitions")

    def written():
        time.sleep(1)
        spark.range(1).count()
        time.sleep(1)
        return store.executorList(False).head().totalShuffleWrite()

    start = written()
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        assert jaccard.candidates(marked, jaccard.LINK).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 0 < written() - start < 14 * sum(398 for _ in docs) / jaccard.FIRST_BLOCK

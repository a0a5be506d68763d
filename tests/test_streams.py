"""Live boards and file streams, against a plain board and over restarts."""

import json
import random

from pyspark.sql import functions as F

from korvane.streaming import live

SCHEMA = "o long, g string, v double"


def plain_snapshots(rows, k):
    """(g, snapshot, rank, score, order) of a board of k for each g that takes rows one by one."""
    boards, numbers, out = {}, {}, []
    for o, g, v in sorted(rows, key=lambda r: (r[0], -(r[2] if r[2] is not None else 0))):
        if v is None or v != v:
            continue
        board = boards.setdefault(g, [])
        new = sorted([*board, (-v, o)])[:k]
        if new != board:
            boards[g], numbers[g] = new, numbers.get(g, 0) + 1
            out += [(g, numbers[g], i, -s, at) for i, (s, at) in enumerate(new, 1)]
    return sorted(out, key=repr)


def snapshots(spark, path, schema):
    rows = spark.read.schema(schema).parquet(path).collect()
    return sorted(((r["g"], r["__snapshot"], r["__rank"], r["__score"], r["o"]) for r in rows), key=repr), rows


def add_file(spark, rows, path, at):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(f"{path}/{at}")


def test_board_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, float("nan"), *map(float, range(12))])) for i in range(300)]
    path, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = spark.createDataFrame([], SCHEMA).schema
    for at in range(0, 300, 100):  # the query ends and starts again for each new folder
        add_file(spark, rows[at : at + 100], path, at)
        stream = live._files(spark, 100, None).schema(schema).parquet(f"{path}/*")
        board = live.board(stream, 4, F.col("v"), "o", ["g"])
        live.into_parquet(board, out, state).awaitTermination()
    got, full = snapshots(spark, out, board.schema)
    assert got == plain_snapshots(rows, 4)
    assert all(json.loads(r["record"])["o"] == r["o"] for r in full)
    live.into_parquet(board, out, state).awaitTermination()  # nothing new
    assert snapshots(spark, out, board.schema)[0] == got


def test_repeated_rows_and_thresholds(spark, tmp_path):
    rows = [(1, "a", 1.0), (1, "a", 1.0), (2, "a", 0.5), (3, "a", 9.0), (3, "a", 4.0)]
    path, schema = str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema
    add_file(spark, rows, path, 0)
    for threshold, mine in ((None, rows), (0.75, [r for r in rows if r[2] >= 0.75])):
        board = live.board(live._files(spark, 9, None).schema(schema).parquet(f"{path}/*"), 3, F.col("v"), "o", ["g"], threshold)
        live.into_parquet(board, str(tmp_path / f"out{threshold}"), str(tmp_path / f"state{threshold}")).awaitTermination()
        assert snapshots(spark, str(tmp_path / f"out{threshold}"), board.schema)[0] == plain_snapshots(mine, 3)


def test_one_board_for_all(spark, tmp_path):
    spark.range(500).select(F.col("id").alias("o"), F.lit("x").alias("g"), (F.col("id") % 10).cast("double").alias("v")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.parquet_stream(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
    board = live.board(stream, 3, F.col("v"), "o")
    live.into_parquet(board, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    last = max(r["__snapshot"] for r in rows)
    assert [(r["__rank"], r["o"]) for r in sorted(rows, key=lambda r: r["__rank"]) if r["__snapshot"] == last] == [(1, 9), (2, 19), (3, 29)]
    assert "g" not in board.columns


def test_thinning_keeps_what_can_enter():
    import numpy as np

    rng = np.random.default_rng(1)
    scores, orders = rng.integers(0, 20, 300).astype(float), rng.permutation(300)
    keep = live.may_enter(scores, orders, 5)
    for i in range(300):
        beaten = ((orders < orders[i]) & (scores >= scores[i])).sum()
        assert keep[i] == (beaten < 5)


def test_line_and_record_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_bytes('﻿{"k": 1, "t": "x"}\r\n\n{"k": "no"}\nnot json\n'.encode())
    lines = live.line_stream(spark, str(folder), name="*.jsonl")
    live.into_parquet(lines, str(tmp_path / "l"), str(tmp_path / "ls")).awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "l")).collect()) == ["not json", '{"k": "no"}', '{"k": 1, "t": "x"}']
    records = live.record_stream(spark, str(folder), "k long, t string")
    live.into_parquet(records, str(tmp_path / "r"), str(tmp_path / "rs")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "r"))
    assert {(r.k, r.t, r["__raw"]) for r in got.collect()} == {(1, "x", None), (None, None, '{"k": "no"}'), (None, None, "not json")}
    assert all(r["__source"].endswith("a.jsonl") for r in got.collect())


def test_boards_of_tables_that_are_folders(spark, duck, sf, tmp_path):
    """Files of a table in any order, a tie across them among the rows that end on the board."""
    from korvane import catalogue
    from tests.compare import same

    for name, order in (("embeddings", "vec_id"), ("events", "event_id")):
        df = spark.read.parquet(f"{sf}/{name}.parquet")
        df.repartition(3, F.pmod(F.hash(order), F.lit(7))).write.parquet(str(tmp_path / f"{name}.parquet"))
    for query in ("live_board_final", "live_board_snapshots"):
        same(catalogue.QUERIES[query](spark, str(tmp_path)), catalogue.ORACLES[query], duck)


def test_ties_across_batches(spark, tmp_path):
    rows = [(5, "a", 2.0), (6, "a", 1.0)], [(1, "a", 1.0)]
    path = str(tmp_path / "in")
    schema = spark.createDataFrame([], SCHEMA).schema
    for at, some in enumerate(rows):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.parquet(f"{path}/{at}")
        board = live.board(live._files(spark, 9, None).schema(schema).parquet(f"{path}/*"), 2, F.col("v"), "o")
        live.into_parquet(board, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    seen = spark.read.parquet(str(tmp_path / "out")).collect()
    last = max(r["__snapshot"] for r in seen)
    assert sorted((r["__rank"], r["o"]) for r in seen if r["__snapshot"] == last) == [(1, 5), (2, 1)]

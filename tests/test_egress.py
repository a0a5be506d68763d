"""Exactly named files, and counts that come with a pass."""

import json
import os

import pytest
from pyspark.sql import functions as F

from korvane.operators import observing
from korvane.sources import egress, readers


def listed(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names)


def test_items_have_their_names(spark, tmp_path):
    df = spark.createDataFrame([(0, "/in/a.b.txt", "A\n"), (1, "/in/c", "é"), (2, "x/.d", None)], "i long, __source string, t string").repartition(3)
    egress.write_items(df, str(tmp_path / "out"), egress.target_name("{stem}/{index}-{name}.{{{ext}}}", df, index="i"), F.col("t"))
    assert listed(tmp_path / "out") == [".d/3-.d.{}", "a.b/1-a.b.txt.{txt}", "c/2-c.{}"]
    assert (tmp_path / "out/a.b/1-a.b.txt.{txt}").read_bytes() == b"A\n" and (tmp_path / "out/c/2-c.{}").read_text() == "é"


def test_lines_keep_their_order(spark, tmp_path):
    rows = [(i, "hot" if i % 3 else f"k{i % 5}", f"line {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "i long, k string, t string").repartition(7)
    egress.write_lines(df, str(tmp_path / "out"), egress.target_name("by/{k}.txt", df), F.col("t"), ["i"])
    assert set(listed(tmp_path / "out")) == {f"by/{k}.txt" for _, k, _ in rows}
    for name in {k for _, k, _ in rows}:
        assert (tmp_path / f"out/by/{name}.txt").read_text() == "".join(f"{t}\n" for _, k, t in rows if k == name)


def test_collisions_and_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", {"b": "x"}), (2, "a", {"b": "y"})], "i long, k string, m map<string, string>").repartition(2)
    root = str(tmp_path / "out")
    with pytest.raises(Exception, match="is written twice"):
        egress.write_items(df, root, egress.target_name("{k}.txt", df), F.col("k"))
    assert listed(root) == [] and os.listdir(root) == []
    egress.write_items(df, root, egress.target_name("{k}-{m.b}.txt", df), F.col("k"))
    assert listed(root) == ["a-x.txt", "a-y.txt"]
    with pytest.raises(Exception, match="exists"):
        egress.write_items(df, root, egress.target_name("{k}-{m.b}.txt", df), F.lit("new"))
    egress.write_items(df, root, egress.target_name("{k}-{m.b}.txt", df), F.lit("new"), replace=True)
    assert (tmp_path / "out/a-x.txt").read_text() == "new" and listed(root) == ["a-x.txt", "a-y.txt"]
    for bad in ("../{i}.txt", "/{i}.txt"):
        with pytest.raises(Exception, match="no file below"):
            egress.write_items(df, root, egress.target_name(bad, df), F.col("k"))
    with pytest.raises(Exception, match="a row has no 'none'"):
        egress.write_items(df, root, egress.target_name("{none}", df), F.col("k"))
    for bad in ("{}", "{0}", "{k", "k}"):
        with pytest.raises(ValueError):
            egress.target_name(bad, df)
    assert listed(root) == ["a-x.txt", "a-y.txt"]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    bad = F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.lit("x"))
    df = spark.range(0, 100, 1, 4)
    with pytest.raises(Exception, match="broken"):
        egress.write_items(df, str(tmp_path / "out"), egress.target_name("{id}.txt", df), bad)
    assert listed(tmp_path / "out") == []


def jobs(spark, action):
    """How many jobs an action starts."""
    group = f"count-{os.urandom(4).hex()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        action()
    finally:
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found


def test_counts_come_with_the_pass(spark, tmp_path):
    rows = [(1, "5", None), (2, "x", 1.0), (3, None, float("nan")), (4, " 7.5 ", 2.0), (5, "", None)]
    df = spark.createDataFrame(rows, "i long, n string, v double").coalesce(2)
    seen = observing.observe(df, {"n": "number", "v": "number"}, "t", F.col("i") > 2)
    one = jobs(spark, lambda: seen.rows.write.parquet(str(tmp_path / "o")))
    assert one == jobs(spark, lambda: df.where("i > 2").write.parquet(str(tmp_path / "p")))
    assert jobs(spark, seen.counts) == 0
    assert seen.counts() == {"seen": 5, "kept": 3, "missing:n": 1, "non_numeric:n": 2, "missing:v": 2, "non_numeric:v": 0}
    assert seen.notes() == ["3 of 5 matched", "field 'v' missing on 2 rows", "field 'n' missing on 1 rows", "field 'n' non-numeric on 2 rows"]
    assert {r.field: (r.missing, r.non_numeric) for r in seen.table().collect()} == {"*": (None, None), "n": (1, 2), "v": (2, 0)}


def test_census(spark, tmp_path):
    (tmp_path / "a.txt").write_text('{"a": 1}\nplain\n{"b": 2}\n[1]\n{"c": 3}\n')
    found = observing.census(readers.lines(spark, [str(tmp_path / "a.txt")]), "c")
    assert sorted(r.j for r in found.rows.where("data is not null").select(F.to_json("data").alias("j")).collect()) == ['{"a":1}', '{"b":2}', '{"c":3}']
    assert (found.counts()["records"], found.counts()["plain"], found.counts()["seen"]) == (3, 2, 5)
    with pytest.raises(observing.MixedRows, match="3 records and 2 plain lines; a plain line at: .*a.txt: "):
        found.require_one_kind()
    only = observing.census(readers.lines(spark, [str(tmp_path / "a.txt")]).where("text like '{%'"), "d")
    only.rows.write.parquet(str(tmp_path / "o"))
    only.require_one_kind()
    assert only.counts()["plain"] == 0
    assert json.loads(spark.read.parquet(str(tmp_path / "o")).select(F.to_json("data")).first()[0])

"""The pipeline on odd and empty tables, and what it leaves behind."""

import os

import corpus_pipeline
from pyspark.sql import functions as F

from korvane.llm import simhash
from korvane.llm._common import new_path, shared_dir


def folder(spark, docs, labels):
    path = new_path(spark, "tables")
    docs.write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def tables(spark):
    root = shared_dir(spark).removeprefix("file://") + "/korvane"
    return set(os.listdir(root)) if os.path.isdir(root) else set()


def test_odd_rows(spark, odd, labels):
    path = folder(spark, odd, labels)
    before = tables(spark)
    out = corpus_pipeline.run(spark, path).collect()
    # The base rules keep the fox and the row without an id; copies of the fox are one document.
    assert {r.doc_id for r in out} <= {1, None} and all(r.round_trip if "round_trip" in r else True for r in out)
    left = tables(spark) - before
    assert len([x for x in left if x.startswith("stage-")]) == 1 and len(left) == 1, left


def test_nothing(spark, nothing, labels):
    out = corpus_pipeline.run(spark, folder(spark, nothing, labels))
    assert out.count() == 0


def test_deduplication_keeps_all_columns(spark, odd):
    more = odd.withColumns({"_s_h1": F.lit("mine"), "_s_row": F.lit(1), "sid": F.lit(2.5), "root2": F.lit(None)})
    got = simhash.deduplicate(more)
    assert got.columns == more.columns
    assert {r["_s_h1"] for r in got.collect()} == {"mine"}
    assert {r.doc_id for r in got.collect()} == {1, 2, 5, 6, 7, 8, None}

"""Audit of a chain of filters: what each filter keeps, removes and duplicates at every place of every order.

A document is known by its mask, the set of filters that it fails. Masks are counted by part and label into a histogram;
stacked, the histograms are the rows of an incidence matrix with one column for each mask. Its products with fixed
integer matrices of (mask, place in an order) give all outcomes at once, whatever the number of documents.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Words, bounded_broadcast, materialize, per_text, pieces

#: The filters, in the order of their bits; D's characters.
FILTERS = "ABCDE"
SYMBOLS = "#$%&*|"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
#: Bytes of text that are worked on at a time.
PIECE = 2 << 20
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


IS_SYMBOL, IS_UPPER = _table(SYMBOLS), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def text_masks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The filters A to D that each text fails, as bits."""
    words = Words(data, offsets)
    n, n_texts = np.diff(words.first_word), len(offsets) - 1
    ids = words.array(data).dictionary_encode().indices.to_numpy().astype(np.int64)
    width = int(ids.max(initial=0)) + 1
    distinct = np.bincount(np.unique(words.doc * width + ids) // width, minlength=n_texts)
    upper, points = per_text(IS_UPPER[data], offsets), per_text((data & 0xC0) != 0x80, offsets)
    fails = (n < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * n, 100 * upper > UPPER_PERCENT * points, per_text(IS_SYMBOL[data], offsets) > 0)
    return sum(f.astype(np.int32) << i for i, f in enumerate(fails))


def with_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, digest) of each document: the filters A to D it fails and its whole text's SHA-256."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("digest", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches, "text", PIECE):
            view = memoryview(np.ascontiguousarray(data))
            digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text_masks(data, offsets).astype(np.int32)), pa.array(digests, pa.binary())], names=schema.names)

    return docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text").mapInArrow(run, schema)


def marked_copies(masks: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of the written table ``masks``, with filter E in the mask: the text also belongs to a
    smaller doc_id.

    A null doc_id is neither smaller nor larger than any. Only texts of several rows take part in the join; copies of
    one text are spread by Spark's skew join or meet a broadcast table of counted size.
    """
    copied = masks.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1").select(F.col("digest").alias("c_digest"), "least")
    copied = materialize(copied, "audit-copied")
    is_copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    joined = masks.join(bounded_broadcast(copied), F.col("digest") == F.col("c_digest"), "left")
    return joined.select("doc_id", "part", (F.col("mask") + F.when(is_copy, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"))


def histograms(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part and mask, and those of them with a label quality 1, toxic 1.

    A document with several labels counts once, as good or toxic if any of them says so; without a label it is neither.
    Rows are summed up before they are shuffled, so a part of a third of all rows is as cheap as any other.
    """
    of_doc = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("l_id"))
    marks = materialize(of_doc.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")), "audit-labels")
    # Rows without an id match no label; salted, they don't meet in one task.
    salt = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(4096))).otherwise(0)
    joined = masks.withColumn("salt", salt).join(bounded_broadcast(marks.withColumn("l_salt", F.lit(0).cast("long"))), (F.col("doc_id") == F.col("l_id")) & (F.col("salt") == F.col("l_salt")), "left")
    count = lambda c: F.count(F.when(F.col(c), 1))
    return joined.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def orders(n_filters: int = len(FILTERS)) -> list[tuple[int, ...]]:
    return list(itertools.permutations(range(n_filters)))


def outcome_matrices(n_filters: int = len(FILTERS)) -> dict[str, np.ndarray]:
    """Integer matrices with a row for each mask and a column for each (order, step): whether a document of that mask is
    kept after the step, removed by it, fails its filter though removed before, or fails its filter and no other.

    ``shapley`` holds what a step's filter removes summed over all orders.
    """
    masks = np.arange(1 << n_filters)
    columns: dict[str, list[np.ndarray]] = {k: [] for k in ("kept", "removed", "redundant", "unique_fails")}
    filters = []
    for order in orders(n_filters):
        before = 0
        for f in order:
            fails, gone = (masks >> f) & 1 == 1, masks & before != 0
            before |= 1 << f
            columns["kept"].append(masks & before == 0)
            columns["removed"].append(fails & ~gone)
            columns["redundant"].append(fails & gone)
            columns["unique_fails"].append(masks == 1 << f)
            filters.append(f)
    out = {k: np.stack(v, axis=1).astype(np.int64) for k, v in columns.items()}
    same = np.equal.outer(filters, filters).astype(np.int64)
    return out | {"shapley": out["removed"] @ same}


def outcomes(counts: DataFrame) -> DataFrame:
    """For the table ``counts`` of ``histograms``: one row per part, order and step with MEASURES.

    Each part is one row of 3 x 32 numbers; a batch of parts is stacked and multiplied at once.
    """
    n = len(FILTERS)
    names = ["".join(FILTERS[f] for f in order) for order in orders()]
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 cells at most
    schema = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)
    matrices = outcome_matrices()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order_column, steps = pa.array(np.repeat(names, n).tolist(), pa.string()), np.tile(np.arange(1, n + 1, dtype=np.int32), len(names))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                cells = some.column(1)
                row = np.repeat(np.arange(some.num_rows), pa.compute.list_value_length(cells).to_numpy())
                flat = cells.flatten()
                stacked = np.zeros((3, some.num_rows, 1 << n), np.int64)  # all, good and toxic documents of each part
                for i, c in enumerate(("n", "good", "toxic")):
                    np.add.at(stacked[i], (row, flat.field("mask").to_numpy()), flat.field(c).to_numpy())
                every, good, toxic = stacked
                got = {k: every @ matrices[k] for k in ("kept", "removed", "redundant", "unique_fails", "shapley")} | {"good_lost": good @ matrices["removed"], "toxic_lost": toxic @ matrices["removed"]}
                parts = some.column(0).take(pa.array(np.repeat(np.arange(some.num_rows), len(steps))))
                yield pa.RecordBatch.from_arrays(
                    [parts, pa.concat_arrays([order_column] * some.num_rows), pa.array(np.tile(steps, some.num_rows)), *(pa.array(got[m].ravel()) for m in MEASURES)], names=["part", "filter_order", "step", *MEASURES]
                )

    return per_part.mapInArrow(run, schema)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction of the five filters on ``docs`` (doc_id, source, text): one row for each part (source; null is
    the empty string), order of the filters and step, with how many documents the step's filter keeps, removes, would
    have removed (``redundant``), fails alone (``unique_fails``), the good and toxic ones it removes, and its removals
    over all orders (``shapley``).

    Filters: A under 50 words, B under 65 % distinct words, C over 5 % A to Z, D holds a symbol, E the text of a smaller
    doc_id. Null texts are empty and fail A; all null and empty texts are copies of each other. Rows repeated with the
    same doc_id don't make each other copies. A null doc_id makes no copy, is none and has no label. Texts are worked on
    whole, one at a time if they are long; equal SHA-256 digests count as equal texts. Other columns are not read, an
    empty table gives no rows.
    """
    masks = materialize(with_masks(docs.select("doc_id", "source", "text")), "audit-masks")
    return outcomes(histograms(marked_copies(masks), labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = rf"""
with w as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
f as (select doc_id, part, len(ws) < {MIN_WORDS} as a, 100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws) as b,
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
        coalesce(doc_id > min(doc_id) over (partition by text), false) as e from w),
m as (select part, concat(if(a, 'A', ''), if(b, 'B', ''), if(c, 'C', ''), if(d, 'D', ''), if(e, 'E', '')) as mask,
        doc_id in (select doc_id from labels where quality = 1 and doc_id is not null) as good, doc_id in (select doc_id from labels where toxic = 1 and doc_id is not null) as toxic from f),
h as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select concat(v.x, w.x, y.x, z.x, u.x) as filter_order from l v, l w, l y, l z, l u where len(list_distinct([v.x, w.x, y.x, z.x, u.x])) = 5),
s as (select filter_order, step, filter_order[step] as x, filter_order[1:step] as upto, filter_order[1:step - 1] as earlier from o, (select unnest(range(1, 6)) as step)),
r as (select part, filter_order, cast(step as integer) as step, x,
        cast(sum(case when len(list_intersect(string_split(mask, ''), string_split(upto, ''))) = 0 or mask = '' then n else 0 end) as bigint) as kept,
        cast(sum(case when contains(mask, x) and gone = 0 then n else 0 end) as bigint) as removed,
        cast(sum(case when contains(mask, x) and gone > 0 then n else 0 end) as bigint) as redundant,
        cast(sum(case when mask = x then n else 0 end) as bigint) as unique_fails,
        cast(sum(case when contains(mask, x) and gone = 0 then good else 0 end) as bigint) as good_lost,
        cast(sum(case when contains(mask, x) and gone = 0 then toxic else 0 end) as bigint) as toxic_lost
      from (select h.*, s.*, case when mask = '' or earlier = '' then 0 else len(list_intersect(string_split(mask, ''), string_split(earlier, ''))) end as gone from h, s)
      group by part, filter_order, step, x)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, x) as bigint) as shapley from r
"""

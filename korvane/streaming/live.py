"""Streams: verbs on live rows, count windows, the snapshots of a live top-k board, event-time counts, file sources."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.readers import clean_lines


#: Rows of snapshots that a task hands on at a time.
FLUSH = 4096


def live(df: DataFrame, verbs: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Row-wise verbs (filters, projections, joins with a static table) applied to a stream in turn."""
    for verb in verbs:
        df = verb(df)
    return df


def count_windows(stream: DataFrame, size: int, value: str, key: str | None = None) -> DataFrame:
    """(key, window_end, total): sums of ``value`` over windows of ``size`` rows in arrival order, for each key.

    A count over all rows needs one order, so without ``key`` one task keeps it; give a key to spread a large stream.
    State is the open window's number and sum.
    """
    named = stream.select((F.col(key).cast("string") if key else F.lit("all")).alias("key"), F.col(value).cast("double").alias("value"))

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, total = state.get if state.exists else (0, 0.0)
        ends, sums = [], []
        for pdf in batches:
            for v in pdf["value"]:
                seen, total = seen + 1, total + (0.0 if pd.isna(v) else v)
                if seen % size == 0:
                    ends.append(seen)
                    sums.append(total)
                    total = 0.0
        state.update((seen, total))
        yield pd.DataFrame({"key": [key[0]] * len(ends), "window_end": ends, "total": sums})

    return named.groupBy("key").applyInPandasWithState(run, "key string, window_end long, total double", "seen long, total double", "append", "NoTimeout")


def may_enter(scores: np.ndarray, orders: np.ndarray, k: int) -> np.ndarray:
    """Of rows in any order, those that fewer than k rows that arrive earlier beat: the others never reach a board of k."""
    keep = np.zeros(len(scores), bool)
    best: list[float] = []  # the k best scores so far, the worst first
    for i in np.lexsort((-scores, orders)):
        if len(best) < k or scores[i] > best[0]:
            keep[i] = True
            (heapq.heappush if len(best) < k else heapq.heapreplace)(best, scores[i])
    return keep


def board(stream: DataFrame, k: int, score: Column, order: str, by: list[str] = (), threshold: float | None = None) -> DataFrame:
    """The snapshots of a live board of the k best rows, for each value of ``by`` (or one for all): whenever a row enters
    the board, its rows as they then are, as (by..., __snapshot, __rank, __score, order, record).

    Rows rank by falling score, then by ``order`` (whole numbers that tell their arrival within a batch); rows repeated in
    both count each, and rows of one ``order`` arrive best first. Batches may come in any order: the last board is the
    same, the snapshots on the way to it are not. Snapshots are numbered from 1, ranks too; record is the row as JSON. Rows without a
    score, with NaN, without an order or below ``threshold`` don't take part. Tasks first drop rows that k earlier ones of
    their batch beat, so the task that keeps a board sees few of its rows; its state is the board and the last number.
    """
    scored = stream.select(*[F.col(f"`{c}`").alias(f"_b{i}") for i, c in enumerate(by)], *([] if by else [F.lit(0).alias("_b0")]), score.cast("double").alias("_score"), F.col(f"`{order}`").cast("long").alias("_order"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
    scored = scored.where("_score is not null and not isnan(_score) and _order is not null")
    if threshold is not None:
        scored = scored.where(F.col("_score") >= threshold)
    keys = [c for c in scored.columns if c.startswith("_b")]

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False).indices.values()
            yield pdf.iloc[np.sort(np.concatenate([np.zeros(0, np.int64), *(rows[may_enter(pdf["_score"].to_numpy()[rows], pdf["_order"].to_numpy()[rows], k)] for rows in groups)]))]

    names = [*by, "__snapshot", "__rank", "__score", order, "record"]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        number, *columns = state.get if state.exists else (0, [], [], [])
        rows = [((-s, o), r) for s, o, r in zip(*columns)]  # the board, best first
        arrived = []
        for pdf in batches:  # rows that the board as it stands beats stay out whatever comes
            some = pdf[pdf["_score"] >= -rows[-1][0][0]] if len(rows) == k else pdf
            arrived += [((-s, o), r) for s, o, r in zip(some["_score"], some["_order"], some["record"])]
        arrived.sort(key=lambda x: (x[0][1], x[0][0]))
        out = []
        for row in arrived:
            if len(rows) == k and row[0] >= rows[-1][0]:
                continue
            bisect.insort_right(rows, row, key=lambda x: x[0])
            del rows[k:]
            number += 1
            out += [(*(key if by else ()), number, i, -at[0], at[1], r) for i, (at, r) in enumerate(rows, 1)]
            if len(out) >= FLUSH:
                yield pd.DataFrame(out, columns=names)
                out = []
        state.update((number, [-at[0] for at, _ in rows], [at[1] for at, _ in rows], [r for _, r in rows]))
        yield pd.DataFrame(out, columns=names)

    fields = [T.StructField(c, stream.schema[c].dataType) for c in by] + [T.StructField("__snapshot", T.LongType()), T.StructField("__rank", T.LongType()), T.StructField("__score", T.DoubleType()), T.StructField(order, T.LongType()), T.StructField("record", T.StringType())]
    kept = scored.mapInPandas(thin, scored.schema)
    return kept.groupBy(*keys).applyInPandasWithState(run, T.StructType(fields), "number long, scores array<double>, orders array<long>, records array<string>", "append", "NoTimeout")


def into_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what there is of a stream as Parquet, each row once, whatever restarts come between; then end."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timed_counts(stream: DataFrame, time: str, width: str, late: str, by: list[str] = ()) -> DataFrame:
    """Counts per time window, closed when the watermark passes; rows later than ``late`` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("count"))


def _files(spark: SparkSession, files_per_batch: int, name: str | None):
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", name) if name else reader


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1, name: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, a few at a time; with ``name``, files of that name (or pattern) only, or, if
    that names a folder of files, those."""
    if name and not set(name) & set("*?[{"):
        inner = spark._jvm.org.apache.hadoop.fs.Path(path, name)
        if inner.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isDirectory(inner):
            path, name = inner.toString(), None
    return _files(spark, files_per_batch, name).schema(schema).parquet(path)


def line_stream(spark: SparkSession, path: str, files_per_batch: int = 1, name: str | None = None) -> DataFrame:
    """(text, __source): lines of the text files that come into a folder, as ``readers.lines`` has them."""
    return clean_lines(_files(spark, files_per_batch, name).text(path))


def record_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1, name: str | None = None) -> DataFrame:
    """JSON lines of the files that come into a folder, as columns of ``schema`` and ``__source``. A line that is no such
    object has nulls and its text in ``__raw``: a stream goes on, unlike a batch."""
    lines = line_stream(spark, path, files_per_batch, name)
    read = F.from_json("text", f"{schema}, __raw string", {"columnNameOfCorruptRecord": "__raw"})
    return lines.select(read.alias("r"), "__source").select("r.*", "__source")

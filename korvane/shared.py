"""The shared folder and written intermediate tables."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table is broadcast only if a count has shown that it has no more rows than this; else the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Bytes of text that a Python worker turns into objects at a time.
PIECE = 2 << 20
#: Spark's setting that removes a query's shuffle files once the query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share. Where that is unset, a temporary folder, which only a
    local master can do with."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = getattr(spark, "_korvane_dir", None) or f"file://{tempfile.mkdtemp(prefix='korvane-')}"
        spark._korvane_dir = base
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/korvane/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors. What its query has
    shuffled goes once the table is written."""
    spark, path = df.sparkSession, new_path(df.sparkSession, tag)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._korvane_path = path
    for made in _SCOPES.get():
        made.append(out)
    return out


#: The tables written in each ``scope`` that is open.
_SCOPES: contextvars.ContextVar[tuple[list[DataFrame], ...]] = contextvars.ContextVar("scopes", default=())


@contextlib.contextmanager
def scope(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Deletes what ``materialize`` writes within it, at its end; what is to stay is added to the list that it gives."""
    made: list[DataFrame] = []
    stay = list(kept)
    token = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield stay
    finally:
        _SCOPES.reset(token)
        names = {t._korvane_path for t in stay if hasattr(t, "_korvane_path")}
        discard(*[t for t in made if t._korvane_path not in names])


def release(spark: SparkSession) -> None:
    """Let go of what finished queries have left: Spark's cleaner drops their broadcasts, on the driver and on executors,
    once the driver's JVM has collected its garbage, and with it what Python no longer refers to. For operators of many
    queries, so a small driver stays small."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has written, once nothing reads them any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._korvane_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``limit`` rows, else as it is.

    Call it on a written table: the count then is cheap.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def pieces(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, in order, with PIECE bytes of a text column at most, or one row; nothing is copied. Without
    rows, a batch is one slice."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(ends) or at == 0:
            before = ends[at - 1] if at else 0
            to = max(int(np.searchsorted(ends, before + PIECE, "right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def with_columns(batch: pa.RecordBatch, names: list[str], *columns: pa.Array) -> pa.RecordBatch:
    """The first columns of ``batch`` as they are, then these, under the ``names`` of all."""
    return pa.RecordBatch.from_arrays([*batch.columns[: len(names) - len(columns)], *columns], names=names)

"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import bounded_broadcast, materialize, release

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source that are summed up together before their sums are summed up.
BUCKET_DOCS = 4096
#: Rows alike that are counted out together.
RUN = 65_536


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` (src, source_size, n_units) with ``target``: words of each source in the mix.

    Sources by code point, null last, weigh ``weights`` in turn. They share ``share`` times all sizes by weight; a
    target stops at ``most`` times its source's size and the excess is shared again until none is above. That end is
    reached in one pass: by rising cap / weight, the sources up to some point are capped and the rest share what is left.
    One row per source; sources are what a mix is configured by, so that table is small and one task orders it.
    """
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("src").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    out = sources.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    out = out.withColumn("ratio", F.col("cap") / F.col("w"))
    out = out.withColumn("left_over", F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    out = out.withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # Capped: its cap is at most its share of what those before it leave. Once one isn't capped, none after it is.
    out = out.withColumn("capped", F.col("ratio") <= F.col("left_over") / F.col("w_left"))
    first_open = F.min(F.when(~F.col("capped"), F.struct("ratio", F.col("left_over").alias("l"), F.col("w_left").alias("wl")))).over(every)
    out = out.withColumn("open", first_open)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.col("open.l") * F.col("w") / F.col("open.wl"))
    return out.select("src", "source_size", "n_units", target.alias("target"))


def numbered_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, src, size, row, task) of each row, a written table. ``row`` tells rows of a scan of files apart: a scan
    gives each row to the same task and place whenever it is read."""
    rows = docs.select("doc_id", F.col("source").alias("src"), word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("task"))
    return materialize(rows, "mix-rows")


def plan(rows: DataFrame, seed: int = 0, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """How often the mix takes rows alike in doc_id, source and size: (doc_id, src, size, n rows, source_size, target,
    times in all), for ``numbered_rows``.

    Weighted fair queueing: a source's rows, shuffled by a seeded hash, queue up ``most`` times over; each entry's
    virtual finish time is the source's words up to and with it, divided by the source's target. All entries are range
    sorted by that time, and the mix is the longest head of that order within the budget (the sum of the targets). Rows
    alike have places of their own in the queue, so a source ends within a row of its target. Null text has size 0; rows
    of size 0 are never taken. Null doc_ids and sources are values of their own. No table of rows is ordered by one task:
    a source is summed up in hash buckets of about BUCKET_DOCS rows, and the global order in its range partitions.
    """
    units = materialize(rows.groupBy("doc_id", "src", "size").agg(F.count(F.lit(1)).alias("n")), "mix-units")
    per_source = units.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_units"))
    targets = bounded_broadcast(materialize(source_targets(per_source, weights, share, most), "mix-targets"))
    known = units.join(targets.withColumnRenamed("src", "t_src"), F.col("src").eqNullSafe(F.col("t_src"))).drop("t_src")
    queue = known.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    if (units.agg(F.max("n")).first()[0] or 0) > RUN:
        queue = queue.repartition("doc_id", "src", "size", "run")  # rows alike by the million are counted out by many tasks
    last = F.least(F.col("n"), (F.col("run") + 1) * RUN)
    queue = queue.withColumn("copy", F.explode(F.sequence(F.col("run") * RUN + 1, last)))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("src"), F.lit("")), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string"), F.col("copy").cast("string")))
    queue = queue.withColumn("key", key)
    # The first 8 hex digits of the key pick the bucket, so buckets follow each other in the order of keys.
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(float(2**32)) * F.ceil(F.col("n_units") / BUCKET_DOCS))
    queue = queue.withColumn("bucket", part)
    sums = queue.groupBy("src", "bucket").agg(F.sum("size").alias("in_bucket"))
    so_far = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("src").alias("b_src"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("in_bucket").over(so_far), F.lit(0)).alias("ahead"))
    in_bucket = Window.partitionBy("src", "bucket").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "copy").rowsBetween(Window.unboundedPreceding, 0)
    queue = queue.withColumn("upto", F.sum("size").over(in_bucket))
    queue = queue.join(bounded_broadcast(materialize(sums, "mix-buckets")), F.col("src").eqNullSafe(F.col("b_src")) & (F.col("bucket") == F.col("b_bucket")))
    entry = F.explode(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: i.cast("long"))).alias("lap")
    words = F.col("ahead") + F.col("upto") + F.col("lap") * F.col("source_size")
    entries = queue.where("size > 0 and target > 0").select("doc_id", "src", "size", "copy", "key", "ahead", "upto", "source_size", "target", entry)
    entries = entries.select("doc_id", "src", "size", "copy", "key", "lap", (words / F.col("target")).alias("finish"))
    order = ["finish", "key", F.col("src").asc_nulls_last(), F.col("doc_id").asc_nulls_last(), "size", "copy", "lap"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = entries.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "mix-order")
    by_part = ranged.groupBy("part").agg(F.sum("size").alias("in_part"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.select("part", F.coalesce(F.sum("in_part").over(ahead), F.lit(0)).alias("before"), "in_part")
    budget = per_source.agg((F.sum("source_size") * F.lit(float(min(share, most)))).alias("budget"))  # the targets' sum, without their rounding
    by_part = by_part.join(F.broadcast(budget), F.col("before") < F.col("budget"))  # one row of budget
    total = F.sum("size").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    taken = ranged.join(F.broadcast(by_part), "part").withColumn("total", F.col("before") + total).where("total <= budget")
    times = taken.groupBy("doc_id", "src", "size").agg(F.count(F.lit(1)).alias("times"))
    times = times.select(F.col("doc_id").alias("c_id"), F.col("src").alias("c_src"), F.col("size").alias("c_size"), "times")
    same = F.col("doc_id").eqNullSafe(F.col("c_id")) & F.col("src").eqNullSafe(F.col("c_src")) & (F.col("size") == F.col("c_size"))
    return known.join(times, same, "left").select("doc_id", "src", "size", "n", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("times", F.lit(0)).alias("times"))


def row_copies(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """``numbered_rows`` with source_size, target and ``copies``: rows alike share their ``times`` as evenly as whole
    numbers allow, those that come first in the scan taking one more. No window holds more than a task's rows."""
    planned = materialize(planned, "mix-plan")
    p = planned.select(F.col("doc_id").alias("p_id"), F.col("src").alias("p_src"), F.col("size").alias("p_size"), "n", "source_size", "target", "times")
    same = F.col("doc_id").eqNullSafe(F.col("p_id")) & F.col("src").eqNullSafe(F.col("p_src")) & (F.col("size") == F.col("p_size"))
    even = F.floor(F.col("times") / F.col("n"))
    more = F.col("times") - even * F.col("n")
    all_rows = rows.join(p, same).select("doc_id", "src", "size", "row", "task", "source_size", "target", even.alias("copies"), more.alias("more"))
    uneven = all_rows.where("more > 0")
    unit = ["doc_id", "src", "size"]
    tasks = materialize(uneven.groupBy(*unit, "task").agg(F.count(F.lit(1)).alias("in_task")), "mix-tasks")
    before = F.coalesce(F.sum("in_task").over(Window.partitionBy(*unit).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    tasks = tasks.select(*[F.col(c).alias(f"t_{c}") for c in (*unit, "task")], before.alias("before"))
    here = F.col("doc_id").eqNullSafe(F.col("t_doc_id")) & F.col("src").eqNullSafe(F.col("t_src")) & (F.col("size") == F.col("t_size")) & (F.col("task") == F.col("t_task"))
    place = F.row_number().over(Window.partitionBy(*unit, "task").orderBy("row")) + F.col("before")
    uneven = uneven.join(tasks, here).withColumn("copies", F.col("copies") + (place <= F.col("more")).cast("long"))
    keep = ["doc_id", "src", "size", "row", "source_size", "target", "copies"]
    return all_rows.where("more = 0").select(*keep).unionByName(uneven.select(*keep))


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: each row of ``docs``, a scan of files, as often as the plan takes it; all columns are kept,
    whatever their names. An empty table gives an empty mix; texts of any length are one entry."""
    rows = numbered_rows(docs)
    copies = row_copies(rows, plan(rows, **options)).where("copies > 0").select(F.col("row").alias("_k_at"), "copies")
    copies = materialize(copies, "mix-copies")
    release(docs.sparkSession)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_k_all"), F.monotonically_increasing_id().alias("_k_row"))
    out = whole.join(copies, F.col("_k_row") == F.col("_k_at")).withColumn("_k_lap", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col("_k_all").getField(c).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: its size, its source's size and target, and the words that the mix takes of it."""
    rows = numbered_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    out = row_copies(rows, plan(rows))
    return out.select("doc_id", F.col("src").alias("source"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
u as (select doc_id, source as src, size, count(*) as n from d group by all),
s as (select src, cast(sum(size * n) as bigint) as source_size from u group by src),
w as (select *, source_size * 2.0::double as cap, [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by src nulls last) - 1) % 3 + 1] as w from s),
r as (select *, cap / w as ratio from w),
l as (select *, (sum(source_size) over ())::double * 1.5::double - coalesce(sum(cap) over (order by ratio, src nulls last rows between unbounded preceding and 1 preceding), 0) as left_over,
        sum(w) over () - coalesce(sum(w) over (order by ratio, src nulls last rows between unbounded preceding and 1 preceding), 0) as w_left from r),
o as (select arg_min(left_over, (ratio, src is null, src)) as ol, arg_min(w_left, (ratio, src is null, src)) as ow from l where not ratio <= left_over / w_left),
t as (select src, source_size, case when ratio <= left_over / w_left then cap else ol * w / ow end as target from l, o),
k as (select u.*, source_size, target, copy, md5(concat_ws('|', '0', coalesce(u.src, ''), coalesce(cast(doc_id as varchar), ''), cast(size as varchar), cast(copy as varchar))) as key
  from (select *, unnest(range(1, n + 1)) as copy from u) u join t on u.src is not distinct from t.src),
c as (select *, sum(size) over (partition by src order by key, doc_id nulls last, size, copy rows unbounded preceding) as upto from k),
e as (select c.*, lap, (upto + lap * source_size)::double / target as finish from c, (values (0), (1)) v(lap) where size > 0 and target > 0),
f as (select *, sum(size) over (order by finish, key, src nulls last, doc_id nulls last, size, copy, lap rows unbounded preceding) as total from e),
g as (select doc_id, src, size, count(*) as times from f where total <= (select sum(source_size) * 1.5 from s) group by all)
select k.doc_id, k.src as source, k.size, k.source_size, coalesce(k.target, 0) as target,
  cast(k.size * (coalesce(times, 0) // n + case when copy <= coalesce(times, 0) % n then 1 else 0 end) as bigint) as taken
from k left join g on k.doc_id is not distinct from g.doc_id and k.src is not distinct from g.src and k.size = g.size
"""

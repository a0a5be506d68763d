"""Order, samples, joins by key, exact duplicates, exploded lists, count windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fields import json_field
from ..functions.predicates import ISO, NUMBER
from ..functions.texts import chunks
from ..shared import materialize, small
from ..sources import writers


def sort_keys(df: DataFrame, field: str, desc: bool = False) -> list[Column]:
    """Sort expressions for a field: missing last either way. Text: if every value is an ISO date or time, by time;
    else in order of code points."""
    c = F.col(f"`{field}`")
    flip = (lambda x: x.desc_nulls_last()) if desc else (lambda x: x.asc_nulls_last())
    if isinstance(df.schema[field].dataType, T.StringType):
        odd = df.where(c.isNotNull() & ~c.rlike(ISO)).limit(1).count()
        return [flip(c.try_cast("timestamp") if not odd else c)]
    return [flip(c)]


def sort_by(df: DataFrame, field: str, desc: bool = False, order: list[str] = ()) -> DataFrame:
    """Stable sort; equal values keep the order of the columns ``order``. A global sort: range partitions, no one task."""
    return df.orderBy(*sort_keys(df, field, desc), *order)


def mixed_sort_keys(value: Column, desc: bool = False) -> list[Column]:
    """Sort expressions for text that mixes numbers and other text: numbers before text, missing last."""
    number = F.when(value.rlike(NUMBER), F.trim(value).try_cast("double"))
    band = F.when(value.isNull(), 2).when(number.isNotNull(), 0).otherwise(1)
    return [band, number.desc_nulls_last() if desc else number.asc_nulls_last(), value.desc_nulls_last() if desc else value.asc_nulls_last()]


def sort_json(df: DataFrame, record: str, path: str, desc: bool = False, order: list[str] = ()) -> DataFrame:
    """Stable sort of JSON records (text) by a field whose type may differ from row to row: if every value there is an ISO
    date or time, by time; else numbers, then text, then anything else by its JSON. ``desc`` turns the order within each
    of these, missing values come last either way."""
    value = json_field(F.col(record), path, "variant")
    kind, text = F.schema_of_variant(value), F.try_variant_get(value, "$", "string")
    there = value.isNotNull() & (kind != "VOID")
    keyed = df.withColumns({"_kind": F.when(there, kind), "_text": F.when(there, F.coalesce(text, F.to_json(value)))})
    is_time = (F.col("_kind") == "STRING") & F.col("_text").rlike(ISO) & F.col("_text").try_cast("timestamp").isNotNull()
    some = keyed.agg(F.count("_kind").alias("n"), F.count(F.when(is_time, 1)).alias("times")).first()
    flip = (lambda c: c.desc_nulls_last()) if desc else (lambda c: c.asc_nulls_last())
    if some.n and some.n == some.times:
        keys = [flip(F.col("_text").try_cast("timestamp"))]
    else:
        number = F.when(F.col("_kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.col("_text").cast("double"))
        keys = [F.when(F.col("_kind").isNull(), 3).when(number.isNotNull(), 0).when(F.col("_kind") == "STRING", 1).otherwise(2), flip(number), flip(F.col("_text"))]
    return keyed.orderBy(*keys, *order).drop("_kind", "_text")


def _draw(seed: int, order: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(order).cast("string")))


def sample(df: DataFrame, n: int, order: str, seed: int = 0) -> DataFrame:
    """n rows drawn without replacement: those whose seeded hash of ``order`` (a unique column) is smallest."""
    return df.withColumn("_draw", _draw(seed, order)).orderBy("_draw", order).limit(n).drop("_draw")


def quotas(df: DataFrame, n: int, by: str, seed: int = 0) -> DataFrame:
    """(stratum, size, quota): n shared out in proportion; what is left goes to the largest remainders, ties by digest."""
    total = df.count()
    take = min(n, total)
    counts = df.groupBy(F.col(by).alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    share = F.col("size") * F.lit(take)
    counts = counts.withColumn("base", F.floor(share / F.lit(max(total, 1)))).withColumn("rest", share % F.lit(max(total, 1)))
    kind = df.schema[by].dataType
    name = "bool" if isinstance(kind, T.BooleanType) else "int" if isinstance(kind, T.IntegralType) else "float" if isinstance(kind, T.NumericType) else "str"
    text = F.concat(F.lit(f"{seed}\0"), F.when(F.col("stratum").isNull(), "missing").otherwise(name), F.lit("\0"), F.coalesce(F.col("stratum").cast("string"), F.lit("")))
    digest = F.sha2(text, 256)
    order = Window.orderBy(F.col("rest").desc(), digest)  # one row for each stratum
    left = F.lit(take) - F.sum("base").over(Window.partitionBy())
    return counts.withColumn("quota", F.col("base") + (F.row_number().over(order) <= left).cast("long")).select("stratum", "size", "quota")


def sample_by(df: DataFrame, n: int, by: str, order: str, seed: int = 0) -> DataFrame:
    """n rows, each stratum with its quota, drawn within it as in ``sample``.

    A stratum's draws are counted in 4096 equal buckets, so that all rows below the bucket where its quota ends stay,
    those above go, and only that bucket's rows are ranked: no task sorts a stratum.
    """
    shares = materialize(quotas(df, n, by, seed), "quotas").select(F.col("stratum").alias("_s"), "quota")
    drawn = df.withColumn("_draw", _draw(seed, order)).withColumn("_bucket", F.substring("_draw", 1, 3))
    counts = drawn.groupBy(F.col(f"`{by}`").alias("_stratum"), "_bucket").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy("_stratum").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    ends = counts.withColumn("upto", upto).join(small(shares), F.col("_stratum").eqNullSafe(F.col("_s")))
    ends = ends.where((F.col("upto") >= F.col("quota")) & (F.col("upto") - F.col("c") < F.col("quota")))
    ends = small(materialize(ends.select("_stratum", F.col("_bucket").alias("_end"), (F.col("quota") - F.col("upto") + F.col("c")).alias("_take")), "sample-ends"))
    some = drawn.join(ends, F.col(f"`{by}`").eqNullSafe(F.col("_stratum"))).where(F.col("_bucket") <= F.col("_end"))
    rank = F.row_number().over(Window.partitionBy("_stratum", "_bucket").orderBy("_draw", order))
    kept = some.withColumn("_rank", rank).where((F.col("_bucket") < F.col("_end")) | (F.col("_rank") <= F.col("_take")))
    return kept.drop("_draw", "_bucket", "_stratum", "_end", "_take", "_rank")


def key_text(c: Column, kind: T.DataType) -> Column:
    """A join key as text: text as it is, anything else as JSON spells it. Null never matches."""
    return c if isinstance(kind, T.StringType) else F.when(c.isNotNull(), F.regexp_replace(F.to_json(F.struct(c.alias("k"))), r'^\{"k":(.*)\}$', "$1"))


def join_on(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], kind: str = "inner") -> DataFrame:
    """Equality join on pairs of fields. "inner" and "leftouter" give (left, right) structs, right null where nothing
    matches; "anti" gives the left rows that match nothing. Missing keys never match; different types meet as text."""
    a, b = left.select(F.struct("*").alias("left")), right.select(F.struct("*").alias("right"))
    on = F.lit(True)
    for x, y in keys:
        p, q = left.schema[x].dataType, right.schema[y].dataType
        u, v = F.col("left").getField(x), F.col("right").getField(y)
        on = on & ((u == v) if p == q else (key_text(u, p) == key_text(v, q)))
    return a.join(b, on, "left_anti").select("left.*") if kind == "anti" else a.join(b, on, {"inner": "inner", "leftouter": "left"}[kind])


def join_keeping_unmatched(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], unmatched: str) -> DataFrame:
    """The inner ``join_on``; the left rows that match nothing are written as JSON lines below ``unmatched``, as they are,
    rows without a key among them."""
    writers.jsonl(join_on(left, right, keys, "anti"), unmatched)
    return join_on(left, right, keys)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows of all frames; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def canonical(df: DataFrame) -> Column:
    """A record as text with its keys sorted; a record of one text column is that text."""
    if len(df.columns) == 1 and isinstance(df.schema[0].dataType, T.StringType):
        return F.col(f"`{df.columns[0]}`")
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})


def distinct_exact(df: DataFrame, order: str, on: list[str] | None = None) -> DataFrame:
    """The first row, by ``order``, of each set of equal rows (equal in ``on``, or in all other columns)."""
    on = on or [c for c in df.columns if c != order]
    key = canonical(df.select(*on))
    firsts = df.groupBy(F.sha2(F.coalesce(key, F.lit("")), 256).alias("k"), key.isNull().alias("z")).agg(F.min(order).alias("_first"))
    return df.join(firsts.select(F.col("_first")), F.col(order) == F.col("_first"), "left_semi")


def distinct_groups(df: DataFrame, order: str, on: list[str], members: int | None = None) -> DataFrame:
    """(kept, count) of each set of rows equal in ``on``; with ``members``, the first so many others as well."""
    counts = df.groupBy(*on).agg(F.min(order).alias("kept"), F.count(F.lit(1)).alias("count"))
    if members is None:
        return counts.select("kept", "count")
    place = F.row_number().over(Window.partitionBy(*on).orderBy(order))
    some = df.withColumn("_place", place).where((F.col("_place") > 1) & (F.col("_place") <= members + 1))
    lists = some.groupBy(*on).agg(F.array_sort(F.collect_list(order)).alias("duplicates"))
    same = F.lit(True)
    renamed = lists.select(*[F.col(c).alias(f"_{c}") for c in on], "duplicates")
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return counts.join(renamed, same, "left").select("kept", "count", F.coalesce("duplicates", F.array().cast(renamed.schema["duplicates"].dataType)).alias("duplicates"))


def explode_field(df: DataFrame, field: str) -> DataFrame:
    """A row for each element of a list, in its place; rows whose field is missing stay, empty lists give no rows.
    A field that is no list is left as it is."""
    if not isinstance(df.schema[field].dataType, T.ArrayType):
        return df
    c = F.col(f"`{field}`")
    element = F.explode(F.when(c.isNull(), F.array(F.lit(None).cast(df.schema[field].dataType.elementType))).otherwise(c)).alias(field)
    return df.select(*[element if name == field else F.col(f"`{name}`") for name in df.columns])


def split_rows(df: DataFrame, text: str, budget: int = 2000, source: str | None = None) -> DataFrame:
    """A row for each chunk of about ``budget`` tokens of each text, which join to the text: the other columns, the chunk
    as ``text``, and __source (path, as, segment from 1, label "name §segment/segments"). ``source`` is the column that
    names a row; without it labels begin with "row". Null and empty texts give no rows."""
    name = F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("row")) if source else F.lit("row")
    short = F.regexp_extract(name, r"([^/\\]*)$", 1)
    others = [F.col(f"`{c}`") for c in df.columns if c not in (text, "text", "__source")]
    parts = df.select(*others, name.alias("_path"), short.alias("_name"), chunks(F.col(f"`{text}`"), budget).alias("_chunks"))
    cut = parts.select("*", F.size("_chunks").alias("_n"), F.posexplode("_chunks").alias("_i", "text")).drop("_chunks")
    spine = F.struct(F.col("_path").alias("path"), F.lit("tokens").alias("as"), (F.col("_i") + 1).alias("segment"), F.concat("_name", F.lit(" §"), F.col("_i") + 1, F.lit("/"), "_n").alias("label"))
    return cut.withColumn("__source", spine).drop("_path", "_name", "_n", "_i")


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with ``_n``, its rows' places (from 1) by ``order``. Places within range partitions are added to the counts
    of the partitions before, so no one task orders all rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("c"))
    ahead = F.coalesce(F.sum("c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_part").alias("_p"), ahead.alias("_ahead"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(F.broadcast(counts), F.col("_part") == F.col("_p")).withColumn("_n", F.col("_ahead") + place).drop("_part", "_p", "_ahead")


def count_windows(df: DataFrame, order: list[str], size: int, every: int | None = None) -> DataFrame:
    """Windows of ``size`` rows, one ending every ``every`` rows (default ``size``) once there are ``size``; ``df`` with
    window_end and partial, a row once for each window it is in.

    What follows the last window is a partial one of the rows since it; if there was none, of all rows.
    """
    every = every or size
    if not 1 <= every <= size:
        raise ValueError("every must be from 1 to size")
    rows = materialize(numbered(df, order), "windows")
    total = rows.agg(F.max("_n")).first()[0] or 0
    last = size + (total - size) // every * every if total >= size else 0
    # The first end at or after a row is the least size + i * every that is; ends go on while the row is inside.
    first = F.greatest(F.lit(size), F.lit(size) + F.ceil((F.col("_n") - size) / every) * every)
    ends = F.when((first <= last) & (first <= F.col("_n") + size - 1), F.sequence(first, F.least(F.lit(last), F.col("_n") + size - 1), F.lit(every).cast("long"))).otherwise(F.array().cast("array<long>"))
    full = rows.withColumn("window_end", F.explode(ends)).withColumn("partial", F.lit(False))
    rest = rows.where(F.col("_n") > last).withColumn("window_end", F.lit(total).cast("long")).withColumn("partial", F.lit(True))
    return full.unionByName(rest).drop("_n")

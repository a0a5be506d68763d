"""Grouped aggregation, tallies, time series, schema profiles, agreement of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import BINS, bin_label, bin_start
from ..shared import materialize, small
from .rows import numbered

QUANTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


#: Groups whose distinct values are counted to be no more than this in all are ranked by a plain window.
WINDOW_ROWS = 1_000_000


def percentiles(df: DataFrame, by: list[str], values: str | dict[str, dict[str, float]], quantiles: dict[str, float] | None = None) -> DataFrame:
    """(by, <name>_<value>): exact nearest rank of each group, the sorted value at q * (n - 1), rounded half to even, to
    4 places; null if a group has no value. ``values`` is a field, or quantiles by field: all fields are one pass.

    A group's distinct values are counted first. If a count of these shows that they are few, each group's are ranked in
    a window; else they are spread over range partitions, and a value's rank is its place within its partition and what
    the group has in the partitions before. No row holds a whole group, and no task a group of unbounded size.
    """
    fields = {values: quantiles or QUANTILES} if isinstance(values, str) else values
    keys = [f"_k{i}" for i in range(len(by))]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("_f"), F.col(f"`{f}`").cast("double").alias("_v")) for i, f in enumerate(fields)]))
    rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(by, keys)], cells.alias("_c")).select(*keys, "_c._f", "_c._v")
    counts = materialize(rows.groupBy(*keys, "_f", "_v").agg(F.count(F.lit(1)).alias("_n")), "percentile-counts")
    here = F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)
    rising = F.col("_v").asc_nulls_first()
    if counts.count() <= WINDOW_ROWS:
        own = Window.partitionBy(*keys, "_f")
        ranked = counts.withColumns({"_all": F.sum(here).over(own), "_upto": F.sum(here).over(own.orderBy(rising).rowsBetween(Window.unboundedPreceding, 0))})
    else:
        ranked = _ranked_by_ranges(counts, [*keys, "_f"], here, rising)
    picks = [
        F.round(F.min(F.when((F.col("_f") == i) & F.col("_v").isNotNull() & (F.col("_upto") > F.bround(F.lit(q) * (F.col("_all") - 1))), F.col("_v"))), 4).alias(f"{name}_{f}")
        for i, (f, wanted) in enumerate(fields.items()) for name, q in wanted.items()
    ]
    out = ranked.groupBy(*keys).agg(*picks)
    return out.select(*[F.col(n).alias(k) for k, n in zip(by, keys)], *[F.col(f"`{name}_{f}`") for f, wanted in fields.items() for name in wanted])


def _ranked_by_ranges(counts: DataFrame, keys: list[str], here: Column, rising: Column) -> DataFrame:
    """``counts`` with _all, the values of its group, and _upto, those up to its own, through range partitions."""
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(counts.repartitionByRange(parts, *keys, "_v").withColumn("_part", F.spark_partition_id()), "percentiles")
    per_part = ranged.groupBy(*keys, "_part").agg(F.sum(here).alias("_in"))
    ahead = F.coalesce(F.sum("_in").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_part = per_part.select(*[F.col(k).alias(f"{k}p") for k in keys], F.col("_part").alias("_p"), ahead.alias("_ahead"), F.sum("_in").over(Window.partitionBy(*keys)).alias("_all"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}p"))
    upto = F.sum(here).over(Window.partitionBy(*keys, "_part").orderBy(rising).rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranged.withColumn("_upto", upto).join(small(materialize(per_part, "percentile-parts")), same)
    return ranked.withColumn("_upto", F.col("_upto") + F.col("_ahead"))


def aggregate(name: str, field: str | None, df: DataFrame) -> Column:
    """``count``, ``sum``, ``avg``, ``min``, ``max`` or ``dcount`` of a field; percentiles come from ``percentiles``.

    Numbers only: text and booleans count as missing, even text that spells a number. Results are rounded to 4 places.
    """
    if name == "count":
        return F.count(F.lit(1)).alias("count")
    kind = df.schema[field].dataType
    c = F.col(f"`{field}`")
    if name == "dcount":
        return F.count_distinct(c.cast("string")).alias(f"dcount_{field}")
    number = c.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
    out = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[name](number)
    return F.round(out, 4).alias(f"{name}_{field}")


def summarize(df: DataFrame, aggs: list[tuple[str, str | None]], by: list[str] = (), bins: dict[str, str] | None = None) -> DataFrame:
    """Aggregates per group, by ``by`` and by time ``bins`` (field: width), whose labels are ``<field>_bin``.

    Missing keys are a group of their own. Empty input gives no rows, even without keys.
    """
    keys = list(by)
    for name, width in (bins or {}).items():
        kind = "string" if isinstance(df.schema[name].dataType, T.StringType) else "time" if not isinstance(df.schema[name].dataType, T.NumericType) else "number"
        df = df.withColumn(f"{name}_bin", bin_label(bin_start(F.col(name), width, kind), width))
        keys.append(f"{name}_bin")
    if not keys:
        df, keys = df.withColumn("_all", F.lit(1)), ["_all"]
    ranks: dict[str, dict[str, float]] = {}
    for a, f in aggs:
        if a in QUANTILES and isinstance(df.schema[f].dataType, T.NumericType):
            ranks.setdefault(f, {})[a] = QUANTILES[a]
    plain = [aggregate(a, f, df) for a, f in aggs if a not in QUANTILES]
    nulls = [F.lit(None).cast("double").alias(f"{a}_{f}") for a, f in aggs if a in QUANTILES and f not in ranks]
    out = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*plain, *nulls) if plain or nulls or not ranks else None
    if ranks:
        found = percentiles(df, keys, ranks)
        same = F.lit(True)
        for i, k in enumerate(keys):
            found = found.withColumnRenamed(k, f"_r{i}")
            same = same & F.col(f"`{k}`" if out is not None else f"_r{i}").eqNullSafe(F.col(f"_r{i}"))
        out = out.join(found, same).drop(*[f"_r{i}" for i in range(len(keys))]) if out is not None else found.withColumnsRenamed({f"_r{i}": k for i, k in enumerate(keys)})
    return out.select(*[F.col(f"`{k}`") for k in keys if k != "_all"], *[F.col("count" if a == "count" else f"`{a}_{f}`") for a, f in aggs])


def tally(df: DataFrame, field: str, top: int | None = 20, order: str | None = None) -> DataFrame:
    """(value, count): how often each value occurs, missing ones as "(missing)"; the ``top`` largest, ties by first
    appearance in ``order`` (else by value)."""
    if top is not None and top <= 0:
        raise ValueError("top must be above zero")
    value = F.coalesce(F.col(field).cast("string"), F.lit("(missing)")).alias("value")
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("count"), (F.min(order) if order else F.min(value)).alias("_first"))
    counts = counts.orderBy(F.col("count").desc(), "_first", "value")
    return (counts.limit(top) if top else counts).drop("_first")


def facets(df: DataFrame, fields: list[str], top: int = 20, order: str | None = None) -> DataFrame:
    """(facet, value, count): several tallies in one pass, each with its ``top`` values, ties by first appearance in
    ``order`` (else by value)."""
    value = lambda f: F.coalesce(F.col(f).cast("string"), F.lit("(missing)"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("facet"), value(f).alias("value")) for f in fields])).alias("p")
    first = F.min("_o") if order else F.min("p.value")
    counts = df.select(pairs, *([F.col(order).alias("_o")] if order else [])).groupBy("p.facet", "p.value").agg(F.count(F.lit(1)).alias("count"), first.alias("_first"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.col("count").desc(), "_first", "value"))
    return counts.withColumn("_rank", rank).where(F.col("_rank") <= top).drop("_rank", "_first")


def by_time(df: DataFrame, field: str, width: str, kind: str = "time") -> DataFrame:
    """(bin_start, count): rows per time bin in order, empty bins between the first and the last as 0."""
    counts = df.select(bin_start(F.col(field), width, kind).alias("s")).where("s is not null").groupBy("s").agg(F.count(F.lit(1)).alias("count"))
    span = counts.agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b", F.lit(BINS[width]).cast("long"))).alias("bin_start"))
    return every.join(counts, F.col("bin_start") == F.col("s"), "left").select("bin_start", F.coalesce("count", F.lit(0)).alias("count"))


_JSON_TYPES = {"BOOLEAN": "boolean", "BIGINT": "integer", "DOUBLE": "number", "STRING": "string", "VOID": "null", "ARRAY": "array", "OBJECT": "object", "DECIMAL": "number"}


def schema_profile(df: DataFrame) -> DataFrame:
    """(field, types, present, rows, coverage): each column's type and the share of rows that have it, in one pass."""
    names = {T.StringType: "string", T.BooleanType: "boolean", T.ArrayType: "array", T.StructType: "object", T.MapType: "object", T.TimestampType: "string", T.TimestampNTZType: "string", T.DateType: "string"}

    def kind(t: T.DataType) -> str:
        return "integer" if isinstance(t, T.IntegralType) else "number" if isinstance(t, T.NumericType) else names.get(type(t), "string")

    once = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"_n{i}") for i, c in enumerate(df.columns)])
    rows = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("field"), F.lit(kind(f.dataType)).alias("types"), F.col(f"_n{i}").alias("present")) for i, f in enumerate(df.schema.fields)])
    out = once.select(F.col("_rows").alias("rows"), F.explode(rows).alias("r")).select("r.position", "r.field", "r.types", "r.present", "rows")
    return out.withColumn("coverage", F.round(100 * F.try_divide("present", "rows"), 1))


def json_profile(df: DataFrame, record: str, order: str | None = None, width: int = 24) -> DataFrame:
    """(field, types, present, rows, coverage) over JSON records given as text: a field's types joined with "|", null
    shown only if it is the only one; the share of rows with a value that isn't null.

    With ``order``, also position (fields as they first appear, those of one record by name) and example: the first value
    that isn't null, as text of ``width`` characters at most, cut with "…"."""
    data = df.select(F.try_parse_json(F.col(record)).alias("d"), *([F.col(order).alias("_o")] if order else []))
    n = data.agg(F.count(F.lit(1)).alias("rows"))
    pairs = data.where(F.schema_of_variant("d").startswith("OBJECT")).lateralJoin(df.sparkSession.tvf.variant_explode_outer(F.col("d").outer())).select("key", "value", *(["_o"] if order else []))
    kind = F.regexp_extract(F.schema_of_variant("value"), r"^([A-Z]+)", 1)
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in _JSON_TYPES.items() for x in p]), kind), F.lit("string"))
    text = F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value"))
    text = F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 1), F.lit("…"))).otherwise(text)
    kinds = pairs.where("key is not null").select("key", F.when(F.col("value").isNull() | (kind == "VOID"), "null").otherwise(label).alias("kind"), *(["_o", text.alias("t")] if order else []))
    first = [F.min("_o").alias("_first"), F.min(F.when(F.col("kind") != "null", F.struct("_o", "t"))).alias("_e")] if order else []
    out = kinds.groupBy(F.col("key").alias("field")).agg(F.array_sort(F.collect_set("kind")).alias("k"), F.count(F.when(F.col("kind") != "null", 1)).alias("present"), *first)
    shown = F.filter("k", lambda x: x != "null")
    place = [F.row_number().over(Window.orderBy("_first", "field")).alias("position"), F.col("_e.t").alias("example")] if order else []  # a row for each field
    out = out.select("field", F.array_join(F.when(F.size(shown) > 0, shown).otherwise(F.col("k")), "|").alias("types"), "present", *place)
    return out.join(F.broadcast(n)).withColumn("coverage", F.round(100 * F.try_divide("present", "rows"), 1))


def label_text(value: Column, kind: T.DataType | None = None) -> Column:
    """Labels as text: text as it is, anything else as JSON spells it; null has none."""
    return F.to_json(value) if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)) else value.cast("string")


def agreement(a: DataFrame, b: DataFrame, on: str, label: str = "label", other: str | None = None) -> DataFrame:
    """The confusion of two labellings joined by a key: (a_label, b_label, count), both labelled.

    Keys must be unique on either side; a key that repeats is an error.
    """
    for side in (a, b):
        if side.where(F.col(on).isNotNull()).groupBy(on).count().where("count > 1").limit(1).count():
            raise ValueError(f"{on} repeats")
    left = a.select(F.col(on), label_text(F.col(label), a.schema[label].dataType).alias("a_label"))
    right = b.select(F.col(on), label_text(F.col(other or label), b.schema[other or label].dataType).alias("b_label"))
    return _confusion(left.join(right, on))


def _confusion(pairs: DataFrame) -> DataFrame:
    return pairs.where("a_label is not null and b_label is not null").groupBy("a_label", "b_label").agg(F.count(F.lit(1)).alias("count"))


def agreement_sides(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """One row: how many keys are in both labellings, only in the first and only in the second; missing keys count as
    only there."""
    # A missing key is null on its own side too, so rows are told apart by a mark.
    left, right = a.select(F.col(on).alias("_a"), F.lit(1).alias("_l")), b.select(F.col(on).alias("_b"), F.lit(1).alias("_r"))
    met = left.join(right, F.col("_a") == F.col("_b"), "full")
    count = lambda c: F.count(F.when(c, 1))
    l, r = F.col("_l").isNotNull(), F.col("_r").isNotNull()  # noqa: E741
    return met.agg(count(l & r).alias("both"), count(l & ~r).alias("a_only"), count(~l & r).alias("b_only"))


def agreement_by_order(a: DataFrame, b: DataFrame, order: list[str], label: str = "label", other: str | None = None) -> DataFrame:
    """The confusion of two labellings of the same rows, told by their places: each side is numbered by ``order`` (range
    partitions, no single task). Sides of different length are an error."""
    left = numbered(a.select(*order, label_text(F.col(label), a.schema[label].dataType).alias("a_label")), list(order)).select("_n", "a_label")
    right = numbered(b.select(*order, label_text(F.col(other or label), b.schema[other or label].dataType).alias("b_label")), list(order)).select("_n", "b_label")
    counts = [f.agg(F.max("_n")).first()[0] or 0 for f in (left, right)]
    if counts[0] != counts[1]:
        raise ValueError(f"{counts[0]} rows on one side and {counts[1]} on the other: give a key instead")
    return _confusion(left.join(right, "_n"))


def agreement_statistics(confusion: DataFrame) -> DataFrame:
    """One row: pairs, observed agreement, Cohen's kappa, Krippendorff's nominal alpha; null where undefined."""
    n = confusion.agg(F.sum("count").alias("n"), F.sum(F.when(F.col("a_label") == F.col("b_label"), F.col("count")).otherwise(0)).alias("same"))
    sides = confusion.select(F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a_label").alias("l")), F.struct(F.lit("b").alias("side"), F.col("b_label").alias("l")))).alias("x"), "count")
    totals = sides.groupBy("x.l").agg(F.sum(F.when(F.col("x.side") == "a", F.col("count")).otherwise(0)).alias("na"), F.sum(F.when(F.col("x.side") == "b", F.col("count")).otherwise(0)).alias("nb"))
    sums = totals.agg(F.sum(F.col("na") * F.col("nb")).alias("ab"), F.sum((F.col("na") + F.col("nb")) * (F.col("na") + F.col("nb") - 1)).alias("cc"))
    out = n.join(F.broadcast(sums)).where("n > 0")
    po, pe = F.col("same") / F.col("n"), F.col("ab") / (F.col("n") * F.col("n"))
    expected = 1 - F.col("cc") / (2 * F.col("n") * (2 * F.col("n") - 1))
    return out.select(F.col("n").alias("pairs"), F.round(po, 4).alias("observed"), F.round(F.when(pe != 1, (po - pe) / (1 - pe)), 4).alias("kappa"), F.round(F.when(expected != 0, 1 - (1 - po) / expected), 4).alias("alpha"))

"""Queries over the driver's tables, one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import fields, predicates, schemas, texts, times
from .functions.vectors import unit_score
from .operators import asking, entities, graph, observing, packing, reducing, rows, semantic, tables, vectors
from .plans import pipelines
from .shared import new_path
from .streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_TOKENS = "cast(greatest(ceil(length(coalesce(text, '')) / 4), length(regexp_replace(coalesce(text, ''), '[^\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef\U00020000-\U0002fa1f]', '', 'g'))) as bigint)"


# Filters and projections


@query("select l_orderkey, l_linenumber from lineitem where l_returnflag = 'R' and l_quantity > 10")
def where_compare(spark, d):
    df = table(spark, d, "lineitem")
    return df.where(predicates.compare(F.col("l_returnflag"), "==", "R") & predicates.compare(F.col("l_quantity"), ">", 10, "number")).select("l_orderkey", "l_linenumber")


@query("select o_orderkey from orders where not (o_orderstatus = 'F' or o_totalprice < 100000) and (o_orderpriority like '1%' or o_orderpriority like '2%')")
def where_bool_tree(spark, d):
    df = table(spark, d, "orders")
    return df.where(~(predicates.compare(F.col("o_orderstatus"), "==", "F") | predicates.compare(F.col("o_totalprice"), "<", 100000, "number")) & predicates.matches(F.col("o_orderpriority"), "^[12]")).select("o_orderkey")


@query("select doc_id from documents where regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])the($|[^A-Za-z0-9_])')")
def where_has(spark, d):
    return table(spark, d, "documents").where(predicates.has(F.col("text"), "the")).select("doc_id")


@query("select doc_id from documents where contains(lower(text), 'idiot')")
def where_contains(spark, d):
    return table(spark, d, "documents").where(predicates.contains(F.col("text"), "IDIOT")).select("doc_id")


@query("select doc_id from documents where regexp_matches(text, '[A-Z]{4,}!')")
def where_matches(spark, d):
    return table(spark, d, "documents").where(predicates.matches(F.col("text"), "[A-Z]{4,}!")).select("doc_id")


@query("select d.doc_id, coalesce(l.toxic = 1, false) as toxic, not coalesce(l.toxic = 1, false) as other from documents d left join labels l using (doc_id)")
def where_not_missing(spark, d):
    """A leaf on a missing field is false, its negation true."""
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    leaf = predicates.compare(F.col("toxic"), "==", 1, "number")
    return df.select("doc_id", leaf.alias("toxic"), (~leaf).alias("other"))


@query("select o_orderkey from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'")
def where_temporal(spark, d):
    c = F.col("o_orderdate")
    return table(spark, d, "orders").where(predicates.compare(c, ">=", "1996-01-01", "time") & predicates.compare(c, "<", "1997-01-01", "time")).select("o_orderkey")


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events where cast(json_extract(props, '$.k') as bigint) > 50")
def where_props_path(spark, d):
    k = fields.json_field(F.col("props"), "k", "bigint")
    return table(spark, d, "events").where(predicates.compare(k, ">", 50, "number")).select("event_id", k.alias("k"))


@query("select event_id, props, user_id from events")
def project_fields(spark, d):
    return fields.project(table(spark, d, "events"), ["event_id", "props", "user_id"])


@query("select event_id, value from events")
def bare(spark, d):
    return fields.bare(table(spark, d, "events").select("event_id", "value", F.lit("x").alias("__source")))


@query("select conv_id, role, unnest(string_split(text, '. ')) as sentence from conversations where text is not null")
def explode_field(spark, d):
    df = table(spark, d, "conversations").where("text is not null").select("conv_id", "role", F.split("text", r"\. ").alias("sentence"))
    return rows.explode_field(df, "sentence")


# Aggregation


SUMMARY_SQL = "select l_linestatus, count(*) as count, round(sum(l_extendedprice), 2) as sum_l_extendedprice, round(list_sort(list(l_quantity))[cast(1 + round_even(0.95 * (count(l_quantity) - 1), 0) as bigint)], 4) as p95_l_quantity from lineitem where l_returnflag = 'R' and l_quantity > 10 group by l_linestatus"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    df = df.where(predicates.compare(F.col("l_returnflag"), "==", "R") & predicates.compare(F.col("l_quantity"), ">", 10, "number"))
    out = tables.summarize(df, [("count", None), ("sum", "l_extendedprice"), ("p95", "l_quantity")], ["l_linestatus"])
    return out.withColumn("sum_l_extendedprice", F.round("sum_l_extendedprice", 2))


@query(SUMMARY_SQL)
def summarize_basic(spark, d):
    return flagship(spark, d)


@query("select l_returnflag, l_linestatus, count(*) as count, round(avg(l_quantity), 4) as avg_l_quantity, min(l_tax) as min_l_tax, max(l_discount) as max_l_discount from lineitem group by all")
def summarize_multi_key(spark, d):
    return tables.summarize(table(spark, d, "lineitem"), [("count", None), ("avg", "l_quantity"), ("min", "l_tax"), ("max", "l_discount")], ["l_returnflag", "l_linestatus"])


_P = ", ".join(f"round(list_sort(list(value))[cast(1 + round_even({q} * (count(value) - 1), 0) as bigint)], 4) as {p}_value" for p, q in tables.QUANTILES.items())


@query(f"select event_type, {_P} from events group by event_type")
def summarize_percentiles(spark, d):
    return tables.summarize(table(spark, d, "events"), [(p, "value") for p in tables.QUANTILES], ["event_type"])


@query(f"select event_type, {_P} from events group by event_type")
def percentiles_at_scale(spark, d):
    out = tables.percentiles(table(spark, d, "events"), ["event_type"], "value")
    return out.select("event_type", *[F.round(f"{p}_value", 4).alias(f"{p}_value") for p in tables.QUANTILES])


@query("select event_type, count(distinct user_id) as dcount_user_id from events group by event_type")
def summarize_dcount(spark, d):
    return tables.summarize(table(spark, d, "events"), [("dcount", "user_id")], ["event_type"])


@query("select strftime(time_bucket(interval 1 hour, ts), '%H:%M') as ts_bin, count(*) as count from events group by 1")
def summarize_bin_hour(spark, d):
    return tables.summarize(table(spark, d, "events"), [("count", None)], bins={"ts": "1h"})


@query("select strftime(ts, '%Y-%m-%d') as ts_bin, event_type, count(*) as count from events group by all")
def summarize_bin_day(spark, d):
    return tables.summarize(table(spark, d, "events"), [("count", None)], ["event_type"], {"ts": "1d"})


@query("select quality, count(*) as count, sum(n_chars)::double as sum_n_chars from documents left join labels using (doc_id) group by quality")
def summarize_null_group(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return tables.summarize(df, [("count", None), ("sum", "n_chars")], ["quality"])


@query("select count(*) as count from region where r_regionkey < 0 having count(*) > 0")
def summarize_empty(spark, d):
    return tables.summarize(table(spark, d, "region").where("r_regionkey < 0"), [("count", None)])


@query("select event_type as value, count(*) as count from events group by 1")
def chart_tally(spark, d):
    return tables.tally(table(spark, d, "events"), "event_type", order="event_id")


@query("select facet, value, count from (select *, row_number() over (partition by facet order by count desc, value) as r from (select 'o_orderstatus' as facet, o_orderstatus as value, count(*) as count from orders group by all union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by all)) where r <= 4")
def chart_facets(spark, d):
    return tables.facets(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], 4)


@query("with c as (select epoch(time_bucket(interval 15 minute, ts))::bigint as s, count(*) as n from events where value > 90 group by 1) select b as bin_start, coalesce(n, 0)::bigint as count from (select unnest(range(min(s), max(s) + 1, 900)) as b from c) left join c on b = s")
def chart_by_time_zero_fill(spark, d):
    return tables.by_time(table(spark, d, "events").where("value > 90"), "ts", "15m")


_DOC_TYPES = [("doc_id", "integer"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "integer")]


@query(" union all ".join(f"select {i} as position, '{c}' as field, '{t}' as types, count({c}) as present, count(*) as rows, round(100 * count({c}) / count(*)::double, 1) as coverage from documents" for i, (c, t) in enumerate(_DOC_TYPES)))
def getschema_typed(spark, d):
    return tables.schema_profile(table(spark, d, "documents"))


@query("select 'k' as field, 'integer' as types, count(json_extract(props, '$.k')) as present, count(*) as rows, round(100 * count(json_extract(props, '$.k')) / count(*)::double, 1) as coverage from events")
def getschema_json(spark, d):
    return tables.json_profile(table(spark, d, "events"), "props")


_CONFUSION = "select cast(quality as varchar) as a_label, cast(toxic as varchar) as b_label, count(*) as count from labels where quality is not null and toxic is not null group by all"


@query(_CONFUSION)
def agree_matrix(spark, d):
    df = table(spark, d, "labels")
    return tables.agreement(df, df, "doc_id", "quality", "toxic")


@query(f"""with c as ({_CONFUSION}), n as (select sum(count)::bigint as n, sum(case when a_label = b_label then count else 0 end)::bigint as same from c),
  t as (select l, sum(a)::double as na, sum(b)::double as nb from (select a_label as l, count as a, 0 as b from c union all select b_label, 0, count from c) group by l),
  s as (select sum(na * nb) as ab, sum((na + nb) * (na + nb - 1)) as cc from t)
  select n as pairs, round(same / n::double, 4) as observed, round((same / n::double - ab / (n::double * n)) / (1 - ab / (n::double * n)), 4) as kappa,
  round(1 - (1 - same / n::double) / (1 - cc / (2.0::double * n * (2 * n - 1))), 4) as alpha from n, s""")
def agree_summary(spark, d):
    df = table(spark, d, "labels")
    return tables.agreement_statistics(tables.agreement(df, df, "doc_id", "quality", "toxic"))


# Order and samples


def _ranked(df: DataFrame, keys: list, name: str) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(F.col(name).isNull()).orderBy(*keys)))


@query("select p_partkey, row_number() over (order by p_retailprice, p_partkey) as place from part")
def sort_num(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_retailprice")
    return rows.numbered(df, rows.sort_keys(df, "p_retailprice") + [F.col("p_partkey")]).select("p_partkey", F.col("_n").alias("place"))


@query("select doc_id, row_number() over (order by quality desc nulls last, doc_id) as place from documents left join labels using (doc_id)")
def sort_desc_missing_last(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality")
    return rows.numbered(df, rows.sort_keys(df, "quality", desc=True) + [F.col("doc_id")]).select("doc_id", F.col("_n").alias("place"))


@query("select o_orderkey, row_number() over (order by strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) as place from orders")
def sort_temporal(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return rows.numbered(df, rows.sort_keys(df, "day") + [F.col("o_orderkey")]).select("o_orderkey", F.col("_n").alias("place"))


@query("select event_id, value from events order by md5(concat_ws('|', '7', cast(event_id as varchar))), event_id limit 500")
def sample_seeded(spark, d):
    return rows.sample(table(spark, d, "events"), 500, "event_id", 7).select("event_id", "value")


_QUOTAS = """with s as (select event_type as stratum, count(*) as size from events group by 1), t as (select *, sum(size) over () as total, 300 as take from s),
b as (select *, (size * take) // total as base, (size * take) % total as rest from t)
select stratum, size, cast(base + case when row_number() over (order by rest desc, sha256('0' || chr(0) || case when stratum is null then 'missing' else 'str' end || chr(0) || coalesce(stratum, ''))) <= take - sum(base) over () then 1 else 0 end as bigint) as quota from b"""


@query(_QUOTAS)
def sample_stratified_quota(spark, d):
    return rows.quotas(table(spark, d, "events"), 300, "event_type")


@query(f"select event_id, event_type from (select e.event_id, e.event_type, quota, row_number() over (partition by e.event_type order by md5(concat_ws('|', '0', cast(event_id as varchar))), event_id) as r from events e join ({_QUOTAS}) q on e.event_type is not distinct from q.stratum) where r <= quota")
def sample_stratified(spark, d):
    return rows.sample_by(table(spark, d, "events"), 300, "event_type", "event_id").select("event_id", "event_type")


# Joins, unions, duplicates


@query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def join_key_inner(spark, d):
    out = rows.join_on(table(spark, d, "orders"), table(spark, d, "customer"), [("o_custkey", "c_custkey")])
    return out.select("left.o_orderkey", "right.c_name")


@query("select d.doc_id, quality from documents d left join labels l using (doc_id)")
def join_key_leftouter(spark, d):
    out = rows.join_on(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), [("doc_id", "doc_id")], "leftouter")
    return out.select("left.doc_id", "right.quality")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)")
def join_key_anti(spark, d):
    out = rows.join_on(table(spark, d, "customer"), table(spark, d, "orders").where("o_totalprice > 300000").select("o_custkey"), [("c_custkey", "o_custkey")], "anti")
    return out.select("c_custkey", "c_name")


@query("select e.event_id, e.user_id from events e join (select distinct cast(c_custkey as varchar) as k, c_nationkey from customer) c on cast(e.user_id as varchar) = c.k where c_nationkey = 3")
def join_key_mixed_types(spark, d):
    """Keys of different types meet as text."""
    right = table(spark, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("k"))
    return rows.join_on(table(spark, d, "events").select("event_id", "user_id"), right, [("user_id", "k")]).select("left.*")


@query("select a.l_orderkey, a.l_linenumber, b.l_quantity from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber = b.l_linenumber where a.l_quantity > 49")
def join_key_multi(spark, d):
    df = table(spark, d, "lineitem")
    left = df.where("l_quantity > 49").select("l_orderkey", "l_linenumber")
    out = rows.join_on(left, df.select("l_orderkey", "l_linenumber", "l_quantity"), [("l_orderkey", "l_orderkey"), ("l_linenumber", "l_linenumber")])
    return out.select("left.l_orderkey", "left.l_linenumber", "right.l_quantity")


@query("select doc_id as id, text from documents union all select item_id, text from benchmark")
def union_chain(spark, d):
    return rows.union_all([table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")])


@query("select min(doc_id) as doc_id from documents group by text, lang")
def distinct_exact(spark, d):
    return rows.distinct_exact(table(spark, d, "documents").select("doc_id", "text", "lang"), "doc_id").select("doc_id")


@query("select kept, count, list_filter(list_slice(l, 2, 4), lambda x: true) as duplicates from (select min(doc_id) as kept, count(*) as count, list_sort(list(doc_id)) as l from documents group by text)")
def distinct_groups(spark, d):
    return rows.distinct_groups(table(spark, d, "documents").select("doc_id", "text"), "doc_id", ["text"], 3)


# Count windows


def _window_sql(size: int, every: int, partial: bool) -> str:
    full = f"select e as window_end, count(*) as rows, round(sum(value), 2) as total from n, (select unnest(range({size}, (select max(n) from n) + 1, {every})) as e) where n > e - {size} and n <= e group by e"
    rest = f"select max(n) as window_end, count(*) as rows, round(sum(value), 2) as total from n where n > (select case when max(n) >= {size} then {size} + (max(n) - {size}) // {every} * {every} else 0 end from n) having count(*) > 0"
    return f"with n as (select row_number() over (order by event_id) as n, value from events) {full}" + (f" union all {rest}" if partial else "")


def _windows(spark, d, size, every=None, partial=True):
    out = rows.count_windows(table(spark, d, "events").select("event_id", "value"), ["event_id"], size, every)
    out = out if partial else out.where("not partial")
    return out.groupBy("window_end").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 2).alias("total"))


@query(_window_sql(100, 100, False))
def window_count_tumbling(spark, d):
    return _windows(spark, d, 100, partial=False)


@query(_window_sql(100, 40, False))
def window_count_sliding(spark, d):
    return _windows(spark, d, 100, 40, partial=False)


@query(_window_sql(97, 97, True))
def window_count_partial(spark, d):
    return _windows(spark, d, 97)


# Vectors


_COS = "(list_inner_product(list_transform(e.embedding, lambda x: x::double), q.v) / (sqrt(list_inner_product(list_transform(e.embedding, lambda x: x::double), list_transform(e.embedding, lambda x: x::double))) * sqrt(list_inner_product(q.v, q.v))))"
_Q = "(select list_transform(embedding, lambda x: x::double) as v from embeddings where vec_id = 0)"


def _near(spark, d) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"])


@query(f"select vec_id, label, round((1 + {_COS}) / 2, 4) as __score from embeddings e, {_Q} q order by {_COS} desc, vec_id limit 20")
def topk_near(spark, d):
    return vectors.top_k(table(spark, d, "embeddings"), "embedding", _near(spark, d), 20, "vec_id")


@query(f"select vec_id, label, round((1 + {_COS}) / 2, 4) as __score from embeddings e, {_Q} q where (1 + {_COS}) / 2 >= 0.7")
def topk_threshold(spark, d):
    return vectors.top_k(table(spark, d, "embeddings"), "embedding", _near(spark, d), None, "vec_id", 0.7)


_UNIT = "u as (select vec_id, label, list_transform(embedding, lambda x: x::double / n) as v from (select *, sqrt(list_inner_product(list_transform(embedding, lambda x: x::double), list_transform(embedding, lambda x: x::double))) as n from embeddings))"


@query(f"with {_UNIT}, p as (select a.vec_id as left_id, b.vec_id as right_id, (1 + list_inner_product(a.v, b.v)) / 2 as s from u a join u b on a.label = b.label where a.vec_id % 50 = 0) select left_id, right_id, rank, round(s, 4) as __score from (select *, cast(row_number() over (partition by left_id order by round(s, 12) desc, right_id) as integer) as rank from p) where rank <= 5")
def join_similarity_blocked(spark, d):
    df = table(spark, d, "embeddings")
    return vectors.similarity_join(df.where("vec_id % 50 = 0"), df, 5, "vec_id", "vec_id", "embedding", block_on=["label"])


@query(f"with {_UNIT}, p as (select a.vec_id, 1 - list_inner_product(a.v, b.v) as d from u a join u b on a.vec_id <> b.vec_id), r as (select *, row_number() over (partition by vec_id order by d) as r from p) select vec_id, round(avg(d), 4) as __distance from r where r <= 5 group by vec_id order by 2 desc, 1 limit 5")
def outliers_knn(spark, d):
    return vectors.outliers(table(spark, d, "embeddings"), "vec_id", "embedding")


_LEADERS = """r as (select 1 as n, [{'o': o, 'v': v}] as leaders from u where n = 1
  union all select u.n, case when len(list_filter(r.leaders, lambda l: list_cosine_similarity(l.v, u.v) >= THRESHOLD - 1e-12)) > 0 then r.leaders else list_append(r.leaders, {'o': u.o, 'v': u.v}) end from r join u on u.n = r.n + 1),
led as (select l.o, l.v from (select unnest(leaders) as l from (select leaders from r order by n desc limit 1)))"""
_FIRSTS = "u as materialized (select vec_id as o, v::double[] as v, row_number() over (order by vec_id) as n from (select min(vec_id) as vec_id, embedding as v from embeddings where embedding is not null group by embedding))"


@query(f"with recursive {_FIRSTS}, {_LEADERS.replace('THRESHOLD', '0.9')} select o as vec_id from led union all select vec_id from embeddings where embedding is null")
def distinct_near(spark, d):
    return vectors.distinct_near(table(spark, d, "embeddings"), "vec_id", "embedding").select("vec_id")


_THRESHOLD = """(select c[1 + len(c) // 2] + 0.35 * (c[1 + least(len(c) - 1, cast(floor(0.95 * len(c)) as bigint))] - c[1 + len(c) // 2]) from (select list_sort(list(list_cosine_similarity(a.v, b.v))) as c
  from u0 a join u0 b on a.n < b.n, (select count(*) as m, count(*) * (count(*) - 1) // 2 as total from u0) where ((a.n - 1) * (2 * m - a.n) // 2 + b.n - a.n - 1) % (case when total > 20000 then total // 20000 + 1 else 1 end) = 0))"""


def _clustered(which: str = "true") -> str:
    """SQL for the clusters of some embeddings: g (o, leader) and s (leader, size, place)."""
    return f"""with recursive u0 as materialized (select vec_id as o, embedding::double[] as v, row_number() over (order by vec_id, embedding) as n from embeddings where embedding is not null and ({which})),
u as materialized (select u0.*, {_THRESHOLD} as t from u0), {_LEADERS.replace('THRESHOLD', 'u.t')},
g as (select u.o, min(led.o) as leader from u join led on led.o <= u.o and list_cosine_similarity(led.v, u.v) >= u.t - 1e-12 group by u.o union all select vec_id, vec_id from embeddings where embedding is null and ({which})),
s as (select leader, count(*) as size, row_number() over (order by count(*) desc, leader) as place from g group by leader)"""


@query(f"{_clustered()} select case when place <= 10 then place end as cluster, cast(sum(size) as bigint) as size, round(sum(size) / (select count(*) from g), 4) as share from s group by 1")
def cluster_sizes(spark, d):
    return vectors.cluster_sizes(vectors.cluster(table(spark, d, "embeddings"), "vec_id", "embedding"), 10)


@query(
    f"""{_clustered("label is not null")}, n as (select count(*) filter (label < 5) as nl, count(*) filter (label >= 5) as nr from embeddings),
p as (select place as cluster, count(*) filter (label < 5) as l, count(*) filter (label >= 5) as r from g join s using (leader) join embeddings e on e.vec_id = g.o group by place)
select cluster, round(l / nl, 4) as left_share, round(r / nr, 4) as right_share, case when l / nl - r / nr >= 0.05 and l >= 2 then 'left' when r / nr - l / nl >= 0.05 and r >= 2 then 'right' end as lean from p, n"""
)
def diff_sides(spark, d):
    df = table(spark, d, "embeddings")
    return vectors.diff(df.where("label < 5"), df.where("label >= 5"), "vec_id", "embedding")


@query(f"select vec_id, round((1 + {_COS}) / 2, 4) as __score from embeddings e, {_Q} q order by {_COS} desc, vec_id limit 20")
def live_board_final(spark, d):
    """The last state of a live board that the table streams through."""
    score = unit_score(F.col("embedding"), F.array(*[F.lit(float(x)) for x in _near(spark, d)]))
    stream = live.parquet_stream(spark, d, table(spark, d, "embeddings").schema, 64, "embeddings.parquet")
    seen = _streamed(spark, live.board(stream, 20, score, "vec_id"))
    last = seen.agg(F.max("__snapshot").alias("last"))
    return seen.join(F.broadcast(last), F.col("__snapshot") == F.col("last")).select("vec_id", F.round("__score", 4).alias("__score"))


def _streamed(spark, stream):
    """A stream's rows once it has ended, as a table."""
    path = new_path(spark, "stream")
    live.into_parquet(stream, path, new_path(spark, "stream-state")).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


_BEATEN = "(select count(*) from events b where b.event_type is not distinct from a.event_type and b.event_id < a.event_id and b.value >= a.value)"


@query(
    f"""with s as (select event_type, event_id, value, {_BEATEN} < 5 as enters from events a where value is not null),
n as (select event_type, count(*) as snapshots from s where enters group by event_type),
r as (select *, row_number() over (partition by event_type order by value desc, event_id) as place from s)
select r.event_type, snapshots, place as rank, event_id, round(value, 4) as score from r join n on r.event_type is not distinct from n.event_type where place <= 5"""
)
def live_board_snapshots(spark, d):
    """The last snapshot of each event type's live board of five, and how many there were."""
    # Snapshots follow the order of ids, which files need not: all files of the table arrive in one batch.
    stream = live.parquet_stream(spark, d, table(spark, d, "events").schema, 1_000_000, "events.parquet")
    seen = _streamed(spark, live.board(stream, 5, F.col("value"), "event_id", ["event_type"]))
    counts = seen.groupBy(F.col("event_type").alias("t")).agg(F.max("__snapshot").alias("snapshots"))
    last = seen.join(F.broadcast(counts), F.col("event_type").eqNullSafe(F.col("t")) & (F.col("__snapshot") == F.col("snapshots")))
    return last.select("event_type", "snapshots", F.col("__rank").alias("rank"), "event_id", F.round("__score", 4).alias("score"))


@query(f"{_clustered()} select place as cluster, concat('cluster ', place) as label from s where leader in (select o from u)")
def cluster_labels(spark, d):
    """Clusters with the members nearest their mean, named without a model."""
    df = table(spark, d, "embeddings")
    examples = vectors.cluster_examples(vectors.cluster(df, "vec_id", "embedding"), df, "vec_id", "embedding", "label")
    return semantic.label_clusters(examples)


# Text


@query("select doc_id, greatest(cast(ceil(length(text) / 4.0) as bigint), len(regexp_extract_all(text, '[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿]'))) as tokens from documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", texts.token_estimate(F.col("text")).alias("tokens"))


@query("select doc_id, text as joined from documents")
def split_tokens(spark, d):
    """Chunks join to the text they were cut from."""
    return table(spark, d, "documents").select("doc_id", F.array_join(texts.chunks(F.col("text"), 500), "").alias("joined"))


@query()
def split_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(texts.chunks(F.col("text"), 500)).alias("segment", "chunk"))


@query(
    f"""with t as (select doc_id, text, {_TOKENS} as tokens from documents where text <> '' and not contains(text, chr(10))),
n as (select *, cast(ceil(tokens / 500) as bigint) as n from t), s as (select *, unnest(range(n)) as i, length(text) // n as width from n)
select doc_id, cast(i + 1 as integer) as segment, concat(doc_id, ' §', i + 1, '/', n) as label, case when i = n - 1 then substr(text, i * width + 1) else substr(text, i * width + 1, width) end as text from s"""
)
def split_labels(spark, d):
    """Texts of one line in even cuts, with their places."""
    df = table(spark, d, "documents").where("not contains(text, chr(10))")
    return rows.split_rows(df.select("doc_id", "text"), "text", 500, "doc_id").select("doc_id", "__source.segment", "__source.label", "text")


_SENTENCES = "string_split_regex(regexp_replace(text, '([.!?…。！？][\"''”’)\\]]*)\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n\\s*\\n')"


@query(f"select doc_id, unnest(range(len(s))) as place, unnest(s) as sentence from (select doc_id, list_filter(list_transform({_SENTENCES}, lambda x: trim(x)), lambda x: x <> '') as s from documents where text is not null)")
def sentence_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(texts.sentences(F.col("text"))).alias("place", "sentence"))


_HIDDEN = "|".join(rf"<{n}\b(?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>.*?(?:</{n}\s*>|\z)" for n in texts.HIDDEN)
_PAGE = f"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<!--.*?(?:-->|\\z)|<[!?][^>]*>', ' ', 'g'),
  '(?is){_HIDDEN}', ' ', 'g'), '(?is)</?(?:{texts.BLOCKS})\\b[^>]*>', chr(10), 'g'), '(?is)</?[a-z][^>]*>', '', 'g')"""


@query(
    f"""with t as (select page_id, {_PAGE} as x from pages),
u as (select page_id, replace(regexp_replace(replace(replace(replace(x, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g'), chr(160), ' ') as x from t)
select page_id, regexp_replace(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from u"""
)
def pages_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", texts.html_text(F.col("html")).alias("text"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def coerce_dates(spark, d):
    forms = F.element_at(F.array(F.lit("yyyy-MM-dd"), F.lit("MMM d yyyy"), F.lit("M/d/yyyy")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    written = F.when(forms == "yyyy-MM-dd", F.date_format("o_orderdate", "yyyy-MM-dd")).when(forms == "M/d/yyyy", F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.date_format("o_orderdate", "MMM d yyyy"))
    return table(spark, d, "orders").select("o_orderkey", times.coerce_date(written).alias("day"))


# Graphs


@query("select cast(n_name as varchar) as source, 'in' as relation, r_name as target, cast(count(*) as bigint) as weight from nation join region on n_regionkey = r_regionkey group by all")
def graph_edges_adopt(spark, d):
    e = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("rel", F.lit("in"))
    return graph.adopt(e, "n_name", "r_name", "rel")


_MENTIONS = "m as (select distinct conv_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?:\\s[A-Z][a-z]+)*')) as name from conversations)"
_FOLDED = f"with {_MENTIONS}, n as (select name, count(*) as n from m group by name), f as (select name, n, first_value(name) over (partition by lower(name) order by n desc, name) as canonical from n)"


def _found(spark, d):
    return graph.mentions(table(spark, d, "conversations"), "conv_id", "text")


@query(_FOLDED + " select canonical as name, cast(sum(n) as bigint) as count from f group by 1")
def graph_nodes(spark, d):
    return graph.nodes(_found(spark, d))


@query(_FOLDED + ", w as (select distinct conv_id, canonical as name from m join f using (name)) select a.name as source, b.name as target, count(*) as weight, cast(greatest(count(*) - 20, 0) as bigint) as hidden from w a join w b on a.conv_id = b.conv_id and a.name < b.name group by all having count(*) >= 2")
def graph_cooccur(spark, d):
    return graph.cooccurrence(_found(spark, d), 2).drop("sources")


def _fact_rule(prompt: str) -> str:
    found = re.search(r"<input>\n(.*) lies in (.*)\n</input>", prompt)
    return json.dumps({"triples": [{"subject": found[1], "relation": "in", "object": found[2]}]})


@query("select cast(n_name as varchar) as source, 'in' as relation, r_name as target, cast(count(*) as bigint) as weight from nation join region on n_regionkey = r_regionkey group by all")
def graph_triples(spark, d):
    """Edges from the facts that a model finds in texts."""
    said = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    said = said.select("n_nationkey", F.concat("n_name", F.lit(" lies in "), "r_name").alias("text"))
    return graph.adopt(graph.triples(said, "n_nationkey", "text", semantic.RuleChat(_fact_rule)), "subject", "object", "relation")


@query(f"with w as (select conv_id, turn, unnest(string_split_regex(regexp_replace(text, '([.!?…。！？][\"''”’)\\]]*)\\s+', '\\1' || chr(1), 'g'), chr(1) || '|\\n\\s*\\n')) as s from conversations) select conv_id, count(*) as sentences from w where trim(s) <> '' group by conv_id")
def graph_sentence_windows(spark, d):
    df = table(spark, d, "conversations").select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    parts = graph.windows(df, "key", "text", "sentence")
    return parts.groupBy(F.split("window", "-")[0].cast("long").alias("conv_id")).agg(F.count(F.lit(1)).alias("sentences"))


@query(
    """with m as (select distinct concat_ws('-', conv_id, turn) as k, unnest(regexp_extract_all(text, '[A-Z][a-z]+(?:\\s[A-Z][a-z]+)*')) as name from conversations where text is not null),
n as (select name, count(*) as n from m group by name), f as (select name, first_value(name) over (partition by lower(name) order by n desc, name) as canonical from n),
w as (select distinct k, canonical as name from m join f using (name))
select a.name as source, b.name as target, count(*) as weight, 'seen together' as relation from w a join w b on a.k = b.k and a.name < b.name group by all having count(*) >= 2 order by weight desc, source, target limit 20"""
)
def graph_named_edges(spark, d):
    """The heaviest co-occurrences, named from their windows by a model."""
    df = table(spark, d, "conversations").where("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    said = graph.windows(df, "key", "text")
    found = graph.mentions(said, "window", "text")
    return graph.name_edges(graph.cooccurrence(found, 2), said, semantic.RuleChat(lambda p: "seen together"))


_FAST = r"""with m as (select concat_ws('-', conv_id, turn) as k, text from conversations where text is not null),
g as (select name from (select k, unnest(list_distinct(regexp_extract_all(text, '[A-Za-z][a-z]{5,}'))) as name from m) group by name having count(distinct k) >= 3),
t as (select k, unnest(ws) as name, unnest(range(len(ws))) as i from (select k, regexp_extract_all(text, '[\p{L}\p{N}_]+') as ws from m)),
h as (select k, i, name, case when length(name) > 8 then 'long' else 'short' end as label from t join g using (name)),
c as (select name, label, count(*) as n, min({'k': k, 'i': i}) as first from h group by name, label),
f as (select name, label, n, first_value(name) over (partition by label, lower(name) order by n desc, first, name) as canonical from c)
"""


def _fast(spark, d):
    df = table(spark, d, "conversations").where("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    names = entities.capitalised_names(df, "text", "key", 3, "[A-Za-z][a-z]{5,}")
    return entities.fast_graph(df, "key", "text", names.withColumn("label", F.when(F.length("name") > 8, "long").otherwise("short")), min_weight=3)


@query(_FAST + ", w as (select distinct k, canonical as name from h join f using (name, label)) select a.name as source, b.name as target, count(*) as weight, cast(greatest(count(*) - 20, 0) as bigint) as hidden from w a join w b on a.k = b.k and a.name < b.name group by all having count(*) >= 3")
def graph_fast(spark, d):
    """What stands together in messages: names from the corpus, longest match, folded within their labels."""
    return _fast(spark, d).edges.drop("sources")


@query(_FAST + " select canonical as name, any_value(label) as label, cast(sum(n) as bigint) as count from f group by canonical")
def graph_fast_nodes(spark, d):
    return _fast(spark, d).nodes


# Models, offline


def _lang_rule(prompt: str) -> str:
    return '{"shout": %s, "size": %d,}' % ("true" if "!!" in prompt else "false", len(prompt.encode("utf-16-le")) // 2)


@query("select contains(text, '!!') as shout, cast(length(text) as bigint) as size from documents where text is not null")
def map_rule(spark, d):
    df = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return semantic.map_rows(df, "{text}", semantic.RuleChat(_lang_rule), "shout boolean, size bigint")


@query("select doc_id, lang, contains(text, '!!') as shout, cast(length(text) as bigint) as size from documents where text is not null")
def extend_rule(spark, d):
    df = table(spark, d, "documents").where("text is not null").select("doc_id", "lang", "text")
    return semantic.extend_rows(df, "{text}", semantic.RuleChat(_lang_rule), "shout boolean, size bigint").drop("text")


@query("select doc_id from documents where not contains(text, '!!')")
def filter_rule(spark, d):
    df = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return semantic.filter_rows(df, "{text}", semantic.RuleChat(lambda p: "yes" if "!!" in p else "no"), invert=True).select("doc_id")


@query("select role, max(length(text))::varchar as result from conversations where text is not null group by role")
def reduce_group(spark, d):
    df = table(spark, d, "conversations").where("text is not null").select("role", F.length("text").cast("string").alias("size"), F.concat_ws("-", "conv_id", "turn").alias("o"))
    longest = semantic.RuleChat(lambda p: max(p.split("\n"), key=int))
    return semantic.reduce_rows(df, "size", "o", "{items}", longest, ["role"], 50)


@query()
def embed_offline(spark, d):
    return semantic.embed(table(spark, d, "benchmark"), "text", semantic.HashingEmbedder()).select("item_id", "vector", "__embedder")


@query("select 'doc_id' as field, count(*) as rows, count(doc_id) as present, count(*) filter (doc_id >= 0) as valid from documents union all select 'lang', count(*), count(lang), count(*) filter (lang in ('en', 'de')) from documents")
def schema_check_coverage(spark, d):
    df = table(spark, d, "documents")
    return semantic.check_records(df, {"doc_id": F.col("doc_id") >= 0, "lang": F.col("lang").isin("en", "de")}, ["doc_id", "lang"])



@query(
    f"""with recursive t as (select source, doc_id, {_TOKENS} as size, row_number() over (partition by source order by doc_id) as n from documents),
p as (select source, doc_id, n, doc_id as opener, size as used, size from t where n = 1
  union all select t.source, t.doc_id, t.n, case when p.used + t.size > 2000 then t.doc_id else p.opener end, case when p.used + t.size > 2000 then t.size else p.used + t.size end, t.size from p join t on t.source is not distinct from p.source and t.n = p.n + 1)
select source, opener, count(*) as documents, cast(sum(size) as bigint) as tokens from p group by source, opener"""
)
def pack_by_budget(spark, d):
    """Each source's documents in chunks of 2000 tokens: the first of each, how many and how much."""
    df = table(spark, d, "documents").select("source", "doc_id", texts.token_estimate(F.col("text")).alias("size"))
    packed = packing.pack(df, ["source"], ["doc_id"], F.col("size"), 2000)
    return packed.groupBy("source", "_chunk").agg(F.min("doc_id").alias("opener"), F.count(F.lit(1)).alias("documents"), F.sum("size").alias("tokens")).drop("_chunk")


def _sum_rule(prompt: str) -> str:
    return str(sum(int(x) for x in prompt.split("\n")))


@query("select role, cast(sum(length(text)) as varchar) as result, count(*) as rows, cast(0 as bigint) as lost from conversations where text is not null and role is not null group by role")
def reduce_budget(spark, d):
    """A tree of notes of 500 tokens each whose notes are sums."""
    df = table(spark, d, "conversations").where("text is not null").select("role", F.length("text").cast("string").alias("size"), F.concat_ws("-", "conv_id", "turn").alias("o"))
    return reducing.reduce_packed(df, "size", "o", "{items}", "{items}", semantic.RuleChat(_sum_rule), 500, ["role"])


_ASKED = "(select count(*) as n, count(distinct lang || '|' || source) as d from documents where lang is not null and source is not null)"


@query(
    f"""select 'first' as run, n as requests, d as distinct, cast(0 as bigint) as hits, d as asked, cast(0 as bigint) as unanswered from {_ASKED}
union all select 'second', n, d, d, cast(0 as bigint), cast(0 as bigint) from {_ASKED}"""
)
def answer_cache_usage(spark, d):
    """What a model is asked about documents' language and source, and what it is asked in a second run."""
    cache, model = asking.AnswerCache(spark, new_path(spark, "answers")), semantic.RuleChat(str.upper)
    question = F.concat("lang", F.lit("|"), "source")
    runs = [asking.ask_cached(table(spark, d, "documents"), question, model, cache, "upper")[1].withColumn("run", F.lit(name)) for name in ("first", "second")]
    return runs[0].unionByName(runs[1])


@query("select doc_id, contains(text, '#') as matches from documents where text is not null")
def judge_long_texts(spark, d):
    """Texts beyond the model's window are judged by chunks, up to the first yes."""
    df = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    judged = asking.judge_long(df, "text", "{text}", semantic.RuleChat(lambda p: "yes" if "#" in p else "no"), 500)
    return judged.select("doc_id", F.col("_match").alias("matches"))


def _count_rule(prompt: str) -> str:
    return str(sum(int(x) for x in prompt[6:].split("\n")) if prompt.startswith("merge\n") else prompt[5:].count("#"))


@query("select doc_id, cast(length(text) - length(replace(text, '#', '')) as varchar) as result from documents where text is not null")
def map_long_texts(spark, d):
    """Texts beyond the model's window are answered by chunks, and the answers merged."""
    df = table(spark, d, "documents").where("text is not null").select("doc_id", "text")
    return asking.map_long(df, "text", "text\n{text}", "merge\n{items}", semantic.RuleChat(_count_rule), 500).select("doc_id", "result")


@query(
    """select '*' as field, cast(null as bigint) as missing, cast(null as bigint) as non_numeric, count(*) as seen, count(*) filter (n_chars > 500) as kept from documents
union all select 'lang', count(*) filter (lang is null), null, null, null from documents
union all select 'source', count(*) filter (source is null), count(*) filter (try_cast(source as double) is null and source is not null), null, null from documents
union all select 'n_chars', count(*) filter (n_chars is null), 0, null, null from documents"""
)
def where_observed_counts(spark, d):
    """What a filter tells about its rows, counted in its own pass."""
    seen = observing.observe(table(spark, d, "documents"), {"lang": "text", "source": "number", "n_chars": "number"}, new_path(spark, "where"), F.col("n_chars") > 500)
    seen.rows.write.format("noop").mode("overwrite").save()
    return seen.table()


_PROPS = {"type": "object", "properties": {"k": {"type": "integer", "minimum": 10}}, "required": ["k"], "additionalProperties": False}


@query("with j as (select event_id, props from events) select 1 as position, 'k' as field, 'integer' as types, count(props) as present, count(*) as rows, 100.0::double as coverage, (select json_extract_string(props, '$.k') from j order by event_id limit 1) as example from j")
def getschema_example(spark, d):
    """Fields in the order of their first appearance, with their first value."""
    return tables.json_profile(table(spark, d, "events"), "props", "event_id")


@query("select event_id, case when k >= 10 then k end as k, k >= 10 as valid, case when k < 10 then 'record.k: is below 10' else '' end as problem from (select event_id, cast(json_extract(props, '$.k') as bigint) as k from events)")
def schema_typed_props(spark, d):
    """Records typed by a schema, and what is wrong with the others."""
    read = schemas.answered(F.col("props"), _PROPS)
    return table(spark, d, "events").select("event_id", read.alias("a")).select("event_id", F.col("a.record.k").alias("k"), (F.size("a.problems") == 0).alias("valid"), F.array_join("a.problems", ", ").alias("problem"))


SEMANTIC = """
[stage.some]
verb = "compare"
field = "n_chars"
op = ">"
to = 200

[stage.typed]
verb = "extend"
prompt = "{lang}:{text}"
model = "shouts"
schema = { shout = "boolean", size = "integer" }

[stage.loud]
verb = "filter"
prompt = "{shout}"
model = "yes"

[stage.count]
verb = "summarize"
aggs = [["count", ""], ["max", "size"]]
by = ["lang"]
"""


def _shout_rule(prompt: str) -> str:
    text = prompt.split(":", 1)[1]
    return json.dumps({"shout": "True" if "!" in text else "false", "size": str(len(text)), "note": "dropped"})


@query("select lang, count(*) as count, cast(max(length(text)) as double) as max_size from documents where n_chars > 200 and contains(text, '!') and lang is not null group by lang")
def pipeline_semantic(spark, d):
    """A pipeline that asks models: typed answers, a verdict on them, a summary."""
    models = {"shouts": semantic.RuleChat(_shout_rule), "yes": semantic.RuleChat(lambda p: "yes" if p == "true" else "no")}
    return pipelines.run(SEMANTIC, table(spark, d, "documents").where("lang is not null and text is not null"), models)


# Pipelines


PIPELINE = """
[stage.hot]
verb = "compare"
field = "value"
op = ">"
to = 50

[stage.count]
verb = "summarize"
aggs = [["count", ""], ["max", "value"]]
by = ["event_type"]
"""


@query("select event_type, count(*) as count, round(max(value), 4) as max_value from events where value > 50 group by event_type")
def pipeline_toml(spark, d):
    return pipelines.run(PIPELINE, table(spark, d, "events"))

"""Similarity top-k, blocked similarity joins, leader clustering, cluster comparison, outliers, near duplicates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, unit_score
from ..shared import BROADCAST_ROWS, discard, materialize, small
from .rows import numbered

#: Rows whose leaders are found at a time, and rows of a block in all-pairs work.
HEAD, BLOCK = 8192, 4096
#: Of the former, rows compared with each other at a time on the driver, and with leaders at a time in a task.
HEAD_BLOCK = 1024
#: Tables of decided rows that are kept apart.
PARTS = 40


def top_k(df: DataFrame, vector: str, near: list[float], k: int | None, order: str, threshold: float | None = None) -> DataFrame:
    """The k rows most like ``near`` by unit score (4 places), ties by ``order``; the threshold applies first. Without k,
    all rows within the threshold, in no order."""
    target = F.array(*[F.lit(float(x)) for x in near])
    scored = df.where(F.col(vector).isNotNull()).withColumn("_exact", unit_score(F.col(vector), target))
    if threshold is not None:
        scored = scored.where(F.col("_exact") >= threshold)
    if k is not None:
        scored = scored.orderBy(F.col("_exact").desc(), order).limit(k)
    return scored.withColumn("__score", F.round("_exact", 4)).drop("_exact", vector)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _stack(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist(), np.float64) if len(series) else np.zeros((0, 0))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k best scores, ties by id."""
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    return np.repeat(np.arange(len(scores)), order.shape[1]), order.ravel()


def similarity_join(left: DataFrame, right: DataFrame, k: int, left_id: str, right_id: str, vector: str, threshold: float | None = None, block_on: list[str] = ()) -> DataFrame:
    """(left_id, right_id, rank, __score): each left row's k most similar right rows, by unit score, ties by right id.

    Rows only meet within equal ``block_on`` keys, if given. Both sides are dealt out in blocks of about BLOCK rows and
    every pair of blocks is one matrix product in a task of its own, which returns k rows for each left row at most; the
    k best over all blocks stay.
    """
    same_id = left_id == right_id
    keys = list(block_on)
    n_left, n_right = (max(1, -(-f.count() // BLOCK)) for f in (left, right))
    a = left.select(F.col(left_id).alias("l_id"), F.col(vector).alias("v"), *keys).withColumn("i", F.pmod(F.xxhash64("l_id"), F.lit(n_left)).cast("int"))
    b = right.select(F.col(right_id).alias("r_id"), F.col(vector).alias("v"), *keys).withColumn("j", F.pmod(F.xxhash64("r_id"), F.lit(n_right)).cast("int"))
    a = a.where("v is not null").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    b = b.where("v is not null").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    lt, rt = left.schema[left_id].dataType.simpleString(), right.schema[right_id].dataType.simpleString()

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"l_id": [], "r_id": [], "s": []})
        scores = np.clip((1 + _unit(_stack(x.v)) @ _unit(_stack(y.v)).T) / 2, 0, 1)
        if threshold is not None:
            scores[scores < threshold] = -1
        r, c = _best(np.round(scores, 12), y.r_id.to_numpy(), k)
        keep = scores[r, c] >= 0
        r, c = r[keep], c[keep]
        return pd.DataFrame({"l_id": x.l_id.to_numpy()[r], "r_id": y.r_id.to_numpy()[c], "s": scores[r, c]})

    met = a.groupBy("i", "j", *keys).cogroup(b.groupBy("i", "j", *keys)).applyInPandas(meet, f"l_id {lt}, r_id {rt}, s double")
    rank = F.row_number().over(Window.partitionBy("l_id").orderBy(F.round("s", 12).desc(), "r_id"))
    out = met.withColumn("rank", rank).where(F.col("rank") <= k)
    names = ("left_id", "right_id") if same_id else (left_id, right_id)
    return out.select(F.col("l_id").alias(names[0]), F.col("r_id").alias(names[1]), "rank", F.round("s", 4).alias("__score"))


def leaders(df: DataFrame, order: str, vector: str, threshold: float) -> DataFrame:
    """(order, leader): greedy clusters in order; a row joins the first leader whose cosine is ``threshold`` or more, or
    leads a cluster itself. Rows without a vector lead themselves.

    Exact. The first HEAD undecided rows are settled in one go, their leaders (HEAD rows at most) go to all workers, and
    every later row that one of them takes is decided; the rest go on. Rows go by their places in the order, so rows
    that repeat an ``order`` or lack one are rows of their own. Rounds grow with the number of leaders, not of rows.
    """
    return _leaders(placed(df, order, vector), order, threshold)


def placed(df: DataFrame, order: str, vector: str) -> DataFrame:
    """(o, v, _n), written: the rows of ``df`` by their places in the order."""
    return materialize(numbered(df.select(F.col(order).alias("o"), F.col(vector).cast("array<double>").alias("v")), ["o", "v"]), "placed")


def _leaders(rest: DataFrame, order: str, threshold: float) -> DataFrame:
    """``leaders`` of rows that ``placed`` has numbered."""
    spark, kind = rest.sparkSession, rest.schema["o"].dataType.simpleString()
    decided = [rest.where("v is null").select("o", F.col("o").alias("leader"))]
    rest = rest.where("v is not null")
    while True:
        head = rest.orderBy("_n").limit(HEAD).toArrow()
        if not head.num_rows:
            break
        v, ids = _unit(np.array(head["v"].to_pylist(), np.float64)), head["o"].to_pylist()
        chosen, first = _greedy(v, threshold)
        settled = [(ids[i], ids[k]) for i, k in enumerate(first.tolist())]
        decided.append(spark.createDataFrame(settled, f"o {kind}, leader {kind}"))
        if len(ids) < HEAD:
            break
        centers, names, last = v[chosen], np.array([ids[i] for i in chosen], object), head["_n"][-1].as_py()

        def take(batches: Iterator[pd.DataFrame], centers=centers, names=names) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                unit = _unit(_stack(pdf.v))
                at, taken = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
                for i in range(0, len(pdf), HEAD_BLOCK):
                    near = unit[i : i + HEAD_BLOCK] @ centers.T >= threshold - 1e-12
                    at[i : i + HEAD_BLOCK], taken[i : i + HEAD_BLOCK] = near.argmax(axis=1), near.any(axis=1)
                pdf["leader"] = pd.Series(names[at], index=pdf.index).where(pd.Series(taken, index=pdf.index))
                pdf["taken"] = taken
                yield pdf

        rest = materialize(rest.where(F.col("_n") > last).mapInPandas(take, f"o {kind}, v array<double>, _n long, leader {kind}, taken boolean"), "leaders")
        decided.append(rest.where("taken").select("o", "leader"))
        rest = rest.where("not taken").select("o", "v", "_n")
        if len(decided) > PARTS:
            decided = [materialize(_union(decided), "leaders")]
    return _union(decided).withColumnRenamed("o", order)


def _greedy(v: np.ndarray, threshold: float) -> tuple[list[int], np.ndarray]:
    """The rows of ``v`` that lead, in order, and each row's leader: the first one near enough. Rows are compared by
    blocks of HEAD_BLOCK, whole blocks with the leaders before them at once."""
    chosen: list[int] = []
    first = np.arange(len(v))
    for at in range(0, len(v), HEAD_BLOCK):
        block = v[at : at + HEAD_BLOCK]
        taken = np.zeros(len(block), bool)
        if chosen:
            near = block @ v[chosen].T >= threshold - 1e-12
            taken = near.any(axis=1)
            first[at : at + len(block)] = np.where(taken, np.array(chosen)[near.argmax(axis=1)], first[at : at + len(block)])
        alike = block @ block.T >= threshold - 1e-12
        for i in np.flatnonzero(~taken).tolist():
            if not taken[i]:
                chosen.append(at + i)
                later = np.flatnonzero(alike[i, i + 1 :] & ~taken[i + 1 :]) + i + 1
                first[at + later] = at + i
                taken[later] = True
    return chosen, first


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def adaptive_threshold(df: DataFrame, order: str, vector: str, budget: int = 20_000) -> float:
    """median + 0.35 * (p95 - median) of pairwise cosines; 0.99 for fewer than three rows. The pairs of all rows in
    ``order`` are taken at an even stride if there are more than ``budget``, so every part of the table has its share."""
    return _threshold(placed(df, order, vector), budget)


def _threshold(rows: DataFrame, budget: int = 20_000) -> float:
    """``adaptive_threshold`` of rows that ``placed`` has numbered. The rows that the ``budget`` pairs need, twice as
    many at most, come to the driver in one pass."""
    ahead = rows.where("v is null").select("_n")
    missing = [r[0] for r in ahead.limit(BROADCAST_ROWS + 1).collect()]
    if len(missing) > BROADCAST_ROWS:  # too many to skip by place: number the others anew
        return _threshold(materialize(numbered(rows.where("v is not null").select("o", "v"), ["o", "v"]), "threshold"), budget)
    n = rows.count() - len(missing)
    if n < 3:
        return 0.99
    total = n * (n - 1) // 2
    at = np.arange(0, total, total // budget + 1 if total > budget else 1)
    back = total - 1 - at  # pairs after this one; the last rows have 1, 2, 3 ... of them
    k = np.array([(math.isqrt(8 * b + 1) - 1) // 2 for b in back.tolist()])
    i, j = n - 1 - k, n - (back - k * (k + 1) // 2)  # places, from 1, among the rows with a vector
    if missing:
        skipped = np.sort(missing) - np.arange(len(missing))
        i, j = (x + np.searchsorted(skipped, x, "right") for x in (i, j))
    wanted = np.union1d(i, j)
    names = rows.sparkSession.createDataFrame(pd.DataFrame({"w": wanted}))
    found = rows.join(F.broadcast(names), F.col("_n") == F.col("w")).select("_n", "v").toPandas().sort_values("_n")
    unit = _unit(_stack(found.v))
    a, b = (unit[np.searchsorted(wanted, x)] for x in (i, j))
    cosines = np.sort(np.einsum("ij,ij->i", a, b))
    median, p95 = cosines[len(cosines) // 2], cosines[min(len(cosines) - 1, int(0.95 * len(cosines)))]
    return float(median + 0.35 * (p95 - median))


def merge_to_k(sizes: list[int], centers: np.ndarray, k: int) -> list[int]:
    """The cluster that each cluster ends in when the smallest (ties: the earliest) joins its most similar one until k
    are left. Clusters are few; this is a loop over them."""
    into, size, left = list(range(len(sizes))), list(sizes), list(range(len(sizes)))
    unit = _unit(centers)
    while len(left) > max(k, 1):
        small_one = min(left, key=lambda i: (size[i], i))
        left.remove(small_one)
        target = max(left, key=lambda i: (float(unit[small_one] @ unit[i]), -i))
        size[target] += size[small_one]
        into = [target if x == small_one else x for x in into]
    return into


def cluster(df: DataFrame, order: str, vector: str, threshold: float | None = None, k: int | None = None) -> DataFrame:
    """(order, cluster): leader clusters, numbered by falling size (ties: first leader); merged down to ``k`` if given."""
    rows = placed(df, order, vector)
    found = materialize(_leaders(rows, order, _threshold(rows) if threshold is None else threshold), "clusters")
    discard(rows)
    if k is not None:
        table = found.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).join(df.select(F.col(order).alias("leader"), vector), "leader").orderBy("leader").toPandas()
        into = merge_to_k(table.n.tolist(), _stack(table[vector]), k)
        moves = df.sparkSession.createDataFrame([(a, table.leader[i]) for a, i in zip(table.leader.tolist(), into)], f"leader {df.schema[order].dataType.simpleString()}, target {df.schema[order].dataType.simpleString()}")
        found = found.join(small(moves), "leader").select(order, F.col("target").alias("leader"))
    sizes = found.groupBy("leader").agg(F.count(F.lit(1)).alias("size"))
    number = F.row_number().over(Window.orderBy(F.col("size").desc(), "leader"))  # a row for each cluster
    return found.join(sizes.withColumn("cluster", number), "leader").select(order, "cluster", "leader")


def cluster_sizes(clusters: DataFrame, top: int | None = None) -> DataFrame:
    """(cluster, size, share); clusters beyond the ``top`` largest are one row, cluster null."""
    name = F.when(F.col("cluster") <= top, F.col("cluster")) if top else F.col("cluster")
    sizes = clusters.groupBy(name.alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    return sizes.withColumn("share", F.round(F.col("size") / F.sum("size").over(Window.partitionBy()), 4))


def cluster_examples(clusters: DataFrame, df: DataFrame, order: str, vector: str, text: str, n: int = 3, width: int = 160) -> DataFrame:
    """(cluster, rank, order, example): each cluster's n members nearest its mean vector, ties by ``order``."""
    members = clusters.select(order, "cluster").join(df.select(order, F.col(vector).alias("_v"), F.col(text).cast("string").alias("_t")), order).where("_v is not null")
    means = members.select("cluster", F.posexplode("_v").alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"))
    means = means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("_mean"))
    near = members.join(means, "cluster").withColumn("_near", F.round(cosine(F.col("_v"), F.col("_mean")), 12))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("_near").desc(), order))
    return near.withColumn("rank", rank).where(F.col("rank") <= n).select("cluster", "rank", order, F.substring("_t", 1, width).alias("example"))


def diff(left: DataFrame, right: DataFrame, order: str, vector: str, threshold: float | None = None, least: float = 0.05, members: int = 2) -> DataFrame:
    """Clusters of both sides together: (cluster, left_share, right_share, lean). A cluster leans to a side if its share
    there is larger by ``least`` and it has ``members`` or more rows there."""
    both = left.select(order, vector, F.lit(True).alias("is_left")).unionByName(right.select(order, vector, F.lit(False).alias("is_left")))
    both = materialize(both, "diff")
    found = cluster(both, order, vector, threshold).join(both.select(order, "is_left"), order)
    n = both.agg(F.count(F.when(F.col("is_left"), 1)).alias("nl"), F.count(F.when(~F.col("is_left"), 1)).alias("nr"))
    per = found.groupBy("cluster").agg(F.count(F.when(F.col("is_left"), 1)).alias("l"), F.count(F.when(~F.col("is_left"), 1)).alias("r")).join(F.broadcast(n))
    a, b = F.coalesce(F.try_divide("l", "nl"), F.lit(0.0)), F.coalesce(F.try_divide("r", "nr"), F.lit(0.0))
    lean = F.when((a - b >= least) & (F.col("l") >= members), "left").when((b - a >= least) & (F.col("r") >= members), "right")
    return per.select("cluster", F.round(a, 4).alias("left_share"), F.round(b, 4).alias("right_share"), lean.alias("lean"))


def outliers(df: DataFrame, order: str, vector: str, n: int = 5, neighbours: int = 5) -> DataFrame:
    """The n rows with the largest mean cosine distance to their nearest neighbours (``__distance``, 4 places); none for
    fewer than three rows."""
    rows = df.where(F.col(vector).isNotNull()).select(order, vector)
    if rows.limit(3).count() < 3:
        return df.limit(0).withColumn("__distance", F.lit(None).cast("double"))
    return _mean_distance(rows, order, vector, neighbours).orderBy(F.col("__distance").desc(), order).limit(n)


def _mean_distance(rows: DataFrame, order: str, vector: str, neighbours: int) -> DataFrame:
    """(order, __distance) of every row, by blocks of all pairs."""
    blocks = max(1, -(-rows.count() // BLOCK))
    kind = rows.schema[order].dataType.simpleString()
    a = rows.select(F.col(order).alias("o"), F.col(vector).alias("v"), F.pmod(F.xxhash64(order), F.lit(blocks)).cast("int").alias("i"))
    b = a.withColumnRenamed("i", "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    a = a.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"o": [], "d": []})
        far = 1 - _unit(_stack(x.v)) @ _unit(_stack(y.v)).T
        far[x.o.to_numpy()[:, None] == y.o.to_numpy()[None]] = np.inf
        near = np.sort(far, axis=1)[:, :neighbours]
        r, c = np.nonzero(np.isfinite(near))
        return pd.DataFrame({"o": x.o.to_numpy()[r], "d": near[r, c]})

    met = a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInPandas(meet, f"o {kind}, d double")
    rank = F.row_number().over(Window.partitionBy("o").orderBy("d"))
    best = met.withColumn("_r", rank).where(F.col("_r") <= neighbours)
    return best.groupBy("o").agg(F.round(F.avg("d"), 4).alias("__distance")).withColumnRenamed("o", order)


def near_groups(df: DataFrame, order: str, vector: str, threshold: float = 0.9, text: str | None = None) -> DataFrame:
    """(order, first, leader), written: for each row the first one, by ``order``, with the same stripped ``text`` (or, not
    given, the same vector), and the row that leads the near duplicates of that one by raw cosine.

    Rows without text, or vector, are alike to none; first rows without a vector lead themselves.
    """
    key = F.sha2(F.trim(F.col(text)), 256) if text else F.when(F.col(vector).isNotNull(), F.to_json(F.struct(vector)))
    rows = df.select(F.col(order).alias("_o"), key.alias("_k"), F.col(vector).alias("_v"))
    firsts = rows.where("_k is not null").groupBy(F.col("_k").alias("_fk")).agg(F.min("_o").alias("first"))
    placed_rows = materialize(rows.join(firsts, F.col("_k") == F.col("_fk"), "left").select("_o", F.coalesce("first", "_o").alias("first"), "_v"), "near-firsts")
    heads = placed_rows.where("_o = first").select(F.col("_o").alias("h"), "_v")
    led = leaders(heads, "h", "_v", threshold)
    out = placed_rows.join(led, F.col("first") == F.col("h")).select(F.col("_o").alias(order), "first", "leader")
    return materialize(out, "near-groups")


def distinct_near(df: DataFrame, order: str, vector: str, threshold: float = 0.9, text: str | None = None) -> DataFrame:
    """The rows that lead their cluster of near duplicates, of rows with equal ``text`` (not given: equal vectors) the
    first in ``order``, a column that tells rows apart."""
    kept = near_groups(df, order, vector, threshold, text).where(F.col(order) == F.col("leader")).select(order)
    return df.join(kept, order, "left_semi")


def distinct_near_groups(df: DataFrame, order: str, vector: str, threshold: float = 0.9, text: str | None = None, members: int = 20) -> DataFrame:
    """(kept, count, duplicates): the kept rows of ``distinct_near`` with how many rows each stands for, itself included,
    and the first ``members`` others: near ones that are first of their text, then rows equal to the kept one, then rows
    equal to a near one, each by ``order``."""
    rows = near_groups(df, order, vector, threshold, text)
    o = F.col(order)
    rank = F.when((o == F.col("first")) & (o != F.col("leader")), 0).when(F.col("first") == F.col("leader"), 1).otherwise(2)
    ranked = rows.where(o != F.col("leader")).select("leader", F.struct(rank.alias("r"), o.alias("o")).alias("m"))
    place = F.row_number().over(Window.partitionBy("leader").orderBy("m"))  # a limit that Spark applies by task first
    first = ranked.withColumn("p", place).where(F.col("p") <= members).groupBy("leader").agg(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["o"]).alias("l"))
    lists = ranked.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).join(first, "leader")
    kept = rows.where(o == F.col("leader")).select(o.alias("kept")).join(lists, F.col("kept") == F.col("leader"), "left")
    return kept.select("kept", (F.coalesce("n", F.lit(0)) + 1).alias("count"), F.coalesce("l", F.array().cast(lists.schema["l"].dataType)).alias("duplicates"))


def geometry(df: DataFrame, stamp: str = "__embedder") -> None:
    """Vectors of different models don't mix: more than one stamp is an error."""
    if df.select(stamp).distinct().limit(2).count() > 1:
        raise ValueError(f"vectors of more than one {stamp}")


def mean_vector(vectors: Column, size: int) -> Column:
    """Mean of an array of vectors of one size."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(F.transform(vectors, lambda v: F.get(v, i).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(vectors))


"""Exact top-k search by inner product with cover trees on both sides.

A cover tree's net at level i holds points at least 2**i apart within 2**i of every point, and the nets are nested: the
net of a level has that of the level above, and every other point of it has its parent there. The top tree is fitted on
a bounded sample; every vector belongs to its nearest node. A group of queries around a node drops the nodes of vectors
whose covering radius keeps all inner products below the group's worst kth score so far, then each query does so for
itself. What is left meets in shards; there both sides get cover trees of their own and node pairs are dropped in the
same way against the running kth scores. Nothing is approximate: the sample only shapes the tree.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialize

#: Vectors that the top tree and the first lower bounds are fitted on, and its number of nodes.
SAMPLE, NODES = 4096, 64
#: Vectors of a shard, queries that meet a shard at a time, and vectors for each node of the trees within.
SHARD, QUERY_CHUNK, LEAF = 1 << 15, 1 << 13, 64
#: Scores are taken for so many queries and vectors at a time.
ROWS, COLUMNS = 256, 4096
EMPTY = -(1 << 62)  # can be negated


def valid(vector: Column) -> Column:
    """Neither null nor with a component that is null, NaN or infinite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False)))


def scaled(vector: Column, scale: int = 1024) -> Column:
    """Components as the integers floor(scale * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Integer lists as rows of equal width; shorter ones are filled with zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.asarray(pa.compute.list_value_length(lists))
    out = np.zeros((len(sizes), width), np.int64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width).astype(np.int64)
    at = 0
    for i, n in enumerate(sizes.tolist()):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where every sum stays below 2**53, in integers otherwise."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T if top < 2**63 else (a.astype(object) @ b.astype(object).T).astype(np.int64)


def net(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Farthest-first choice of up to n points: their indices, each one's distance from those before it (the first:
    infinite), and each point's nearest choice (its number) and distance.

    The distances fall, so the choices at a distance of 2**i or more are a cover tree's net at level i.
    """
    x = points.astype(np.float64)
    chosen, apart, node, far = [0], [math.inf], np.zeros(len(x), np.int64), np.linalg.norm(x - x[0], axis=1)
    while len(chosen) < min(n, len(x)):
        i = int(far.argmax())
        if far[i] == 0:
            break
        d = np.linalg.norm(x - x[i], axis=1)
        closer = d < far
        node[closer], far[closer] = len(chosen), d[closer]
        chosen.append(i)
        apart.append(float(d[chosen[:-1]].min()))
    return np.array(chosen), np.array(apart), node, far


def nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest center of each point and its distance."""
    x, c = points.astype(np.float64), centers.astype(np.float64)
    square = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]
    node = square.argmin(1)
    return node, np.linalg.norm(x - c[node], axis=1)


def ceiling(qc: np.ndarray, qr: float, cc: np.ndarray, cr: np.ndarray) -> np.ndarray:
    """No inner product of a point within qr of qc and one within cr of cc is larger; a little room for rounding."""
    qn, cn = np.linalg.norm(qc), np.linalg.norm(cc, axis=1)
    top = cc @ qc + qn * cr + cn * qr + qr * cr
    return top + 1e-9 * (qn + qr) * (cn + cr) + 1e-6


class Node:
    """A node of a cover tree: a point at a level, all vectors below it and their covering radius."""

    def __init__(self, points: np.ndarray, at: int, level: int, members: np.ndarray, children: list[Node]) -> None:
        self.at, self.level, self.members, self.children = at, level, members, children
        self.center = points[at].astype(np.float64)
        self.radius = float(np.linalg.norm(points[members].astype(np.float64) - self.center, axis=1).max())
        self.centers = np.array([c.center for c in children])
        self.radii = np.array([c.radius for c in children])


def cover_tree(points: np.ndarray, n: int) -> Node:
    """The cover tree of up to n points; every point belongs to the leaf of the nearest of them.

    Children of a node at level i are at the next lower level j that splits it, the node's own point first, at least
    2**j apart (as all nodes of level j are) and within 2**(j + 1) of it.
    """
    chosen, apart, node, _ = net(points, n)
    levels = np.floor(np.log2(apart[1:])).astype(int)
    below: list[list[int]] = [[] for _ in chosen]
    level = [int(levels[0]) + 1 if len(levels) else 0, *levels.tolist()]
    for k in range(1, len(chosen)):
        above = int(np.searchsorted(-levels, -levels[k - 1], "left")) + 1  # choices of a higher level come first
        parent = int(np.linalg.norm((points[chosen[:above]] - points[chosen[k]]).astype(np.float64), axis=1).argmin())
        below[parent].append(k)
    order = np.argsort(node, kind="stable")
    own = np.split(order, np.searchsorted(node[order], np.arange(1, len(chosen))))

    def build(k: int, top: int) -> Node:
        lower = [c for c in below[k] if level[c] < top]
        if not lower:
            return Node(points, int(chosen[k]), top, own[k], [])
        j = max(level[c] for c in lower)
        children = [build(k, j), *(build(c, j) for c in lower if level[c] == j)]
        return Node(points, int(chosen[k]), top, np.concatenate([c.members for c in children]), children)

    return build(0, level[0])


class Search:
    """Dual-tree search; ``floor`` is a score that each query's kth surely reaches (EMPTY if none is known)."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.q_ids, self.q, self.c_ids, self.c, self.k = q_ids, q, c_ids, c, k
        self.worst = floor.copy()
        self.found: list[list[tuple[int, int]]] = [[] for _ in q_ids]

    def run(self) -> list[tuple[int, int, int]]:
        if len(self.q) and len(self.c):
            a, b = (cover_tree(x, math.ceil(len(x) / LEAF)) for x in (self.q, self.c))
            self.visit(a, b)
        return [(int(self.q_ids[i]), -neg, score) for i, heap in enumerate(self.found) for score, neg in heap]

    def visit(self, a: Node, b: Node) -> None:
        if b.children and (not a.children or b.radius >= a.radius):
            top = ceiling(a.center, a.radius, b.centers, b.radii)
            for i in np.argsort(-top).tolist():
                if top[i] >= self.worst[a.members].min():
                    self.visit(a, b.children[i])
        elif a.children:
            top = ceiling(b.center, b.radius, a.centers, a.radii)
            for child, most in zip(a.children, top.tolist()):
                if most >= self.worst[child.members].min():
                    self.visit(child, b)
        else:
            for x in range(0, len(a.members), ROWS):
                for y in range(0, len(b.members), COLUMNS):
                    self.compare(a.members[x : x + ROWS], b.members[y : y + COLUMNS])

    def compare(self, rows: np.ndarray, columns: np.ndarray) -> None:
        scores = products(self.q[rows], self.c[columns])
        good = (scores >= self.worst[rows][:, None]) & (self.q_ids[rows][:, None] != self.c_ids[columns][None])
        for r, c in zip(*(x.tolist() for x in np.nonzero(good))):
            i = int(rows[r])
            entry = (int(scores[r, c]), -int(self.c_ids[columns[c]]))
            heap = self.found[i]
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.worst[i] = max(self.worst[i], heap[0][0])


def first_floor(v: np.ndarray, ids: np.ndarray, s: np.ndarray, s_ids: np.ndarray, k: int) -> np.ndarray:
    """The kth best score of each query among the sample, EMPTY if it has fewer; its own id does not count."""
    scores = products(v, s)
    scores[ids[:, None] == s_ids[None]] = EMPTY
    if scores.shape[1] < k:
        return np.full(len(v), EMPTY)
    return -np.partition(-scores, k - 1, axis=1)[:, k - 1]


def met_nodes(v: np.ndarray, floor: np.ndarray, centers: np.ndarray, sizes: dict[int, float]) -> list[np.ndarray]:
    """The nodes (their radii in ``sizes``) that may hold one of each query's best: first those of its group, the
    queries nearest to the same node, by the group's covering radius and worst floor; then its own."""
    nodes = np.array(sorted(sizes))
    cc, cr = centers[nodes].astype(np.float64), np.array([sizes[n] for n in nodes.tolist()])
    group, far = nearest(v, centers)
    out: list[np.ndarray] = [nodes[:0]] * len(v)
    for g in np.unique(group).tolist():
        mine = np.flatnonzero(group == g)
        left = np.flatnonzero(ceiling(centers[g].astype(np.float64), float(far[mine].max()), cc, cr) >= floor[mine].min())
        for i in mine.tolist():
            out[i] = nodes[left[ceiling(v[i].astype(np.float64), 0.0, cc[left], cr[left]) >= floor[i]]]
    return out


def search(vectors: DataFrame, k: int = 10, is_query: Column | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query with all other rows, ties to the
    smaller vec_id.

    ``vectors``: vec_id, v (array of long, no nulls). Rows without a vec_id take no part; a shorter vector counts as
    filled with zeros. Of query rows that repeat a vec_id the smallest vector asks; all rows are candidates, repeated
    ones each for itself, but none with the query's own vec_id. Fewer candidates than k give fewer rows, an empty table
    none. Other columns, whatever their names, are not read.
    """
    spark = vectors.sparkSession
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    is_query = is_query if is_query is not None else F.col("vec_id") % 100 == 0
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).toArrow()
    width = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    out_schema = "query_id long, rank int, vec_id long, score long"
    if sample.num_rows == 0:
        return spark.createDataFrame([], out_schema)
    s_ids, s = sample["vec_id"].to_numpy(), matrix(sample["v"].combine_chunks(), width)
    centers = s[net(s, NODES)[0]]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, far = nearest(matrix(batch.column(1), width), centers)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node.astype(np.int32)), pa.array(far)], names=["vec_id", "v", "node", "far"])

    placed = materialize(rows.mapInArrow(assign, "vec_id long, v array<long>, node int, far double"), "topk-placed")
    # At most NODES rows.
    sized = {r.node: (r.n, r.radius) for r in placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}
    radii = {n: radius for n, (_, radius) in sized.items()}

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                v, ids = matrix(batch.column(1), width), batch.column(0).to_numpy()
                floor = first_floor(v, ids, s, s_ids, k)
                met = pa.array([n.tolist() for n in met_nodes(v, floor, centers, radii)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floor.astype(np.int64)), met], names=["vec_id", "v", "floor", "nodes"])

    asking = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    asking = materialize(asking.mapInArrow(prune, "vec_id long, v array<long>, floor long, nodes array<int>"), "topk-queries")
    # At most NODES rows: a node's vectors are dealt to shards, and copied once for each QUERY_CHUNK queries that meet it.
    counts = asking.select(F.explode("nodes").alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return spark.createDataFrame([], out_schema)
    plan = F.broadcast(spark.createDataFrame([(r.node, math.ceil(sized[r.node][0] / SHARD), math.ceil(r.n / QUERY_CHUNK)) for r in counts], "node int, shards int, chunks int"))
    q = asking.select("vec_id", "v", "floor", F.explode("nodes").alias("node")).join(plan, "node")
    q = q.select("vec_id", "v", "floor", "node", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("vec_id"), "chunks").cast("int").alias("chunk"))
    c = placed.join(plan, "node").select("vec_id", "v", "node", F.pmod(F.xxhash64("vec_id", "v"), "shards").cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if left.num_rows == 0 or right.num_rows == 0:
            return none
        found = Search(left["vec_id"].to_numpy(), matrix(left["v"].combine_chunks(), width), right["vec_id"].to_numpy(), matrix(right["v"].combine_chunks(), width), left["floor"].to_numpy(), k).run()
        return pa.table({n: pa.array([f[i] for f in found], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    keys = ("node", "shard", "chunk")
    partial = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all others, by the inner product of floor(1024 * x)."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(valid(F.col("embedding")))
    return search(rows.select("vec_id", scaled(F.col("embedding")).alias("v")))


ORACLE = """
with e as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from e q join e c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""

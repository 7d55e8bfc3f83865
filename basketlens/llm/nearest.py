"""Approximate nearest neighbours by stable projections and kd-trees (operator 1).

Largest inner products are nearest neighbours once every vector gets one more
component, sqrt(M^2 - |x|^2) (M: the largest norm; 0 for queries): then
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x. The vectors are projected on a few Gaussian
directions, for which (projected distance / distance)^2 follows a chi-square
law. A search takes points in the order of projected distance and verifies
them on the original vectors; it stops when the next projected distance r
satisfies chi2cdf(r^2 / d_k^2) >= confidence, d_k being the k-th distance so
far: a closer vector would have shown up with that probability.

Distribution: a kd-tree over a bounded sample of projections cuts the space
into cells; every vector is put in its cell, and a cell of many vectors (one
vector may repeat very often) is split into blocks by hash. Round one searches
a block of each query's own cell, which bounds its k-th distance. Round two
sends the query to the blocks of all cells that the stopping test leaves open.
Tasks get a block and at most ``QUERIES`` queries; within a block a kd-tree
gives the incremental order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketlens.llm.common import cut, numpy_columns

SAMPLE = 16_384       # projections that the cells are fitted on; every row is indexed
CELLS = 1024          # most cells
ROWS = 8192           # rows of a block
QUERIES = 4096        # queries of a task
LEAF = 64             # rows of a leaf of a block's tree
LEAVES = 8            # leaves a query takes before its bound is tested again


def chi2_quantile(p: float, df: int) -> float:
    """Quantile of the chi-square law with an even number of degrees of freedom, by bisection of its closed form."""
    def cdf(x: float) -> float:
        term = total = 1.0
        for i in range(1, df // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total
    low, high = 0.0, 10.0 * df + 200
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


def split_tree(points: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """Median splits (dimension, value) of a complete binary tree with ``leaves`` (a power of two) leaves, in heap order."""
    tree: list[tuple[int, float]] = [(0, 0.0)] * (leaves - 1)
    parts = {0: points}
    for node in range(leaves - 1):
        part = parts.pop(node)
        dim = int(np.argmax(part.max(0) - part.min(0))) if len(part) else 0
        value = float(np.median(part[:, dim])) if len(part) else 0.0
        tree[node] = (dim, value)
        if 2 * node + 2 < leaves - 1:
            left = part[:, dim] < value
            parts[2 * node + 1], parts[2 * node + 2] = part[left], part[~left]
    return tree


def descend(points: np.ndarray, tree: list[tuple[int, float]]) -> np.ndarray:
    """Leaf of each point."""
    node = np.zeros(len(points), np.int64)
    dims, values = np.array([t[0] for t in tree], np.int64), np.array([t[1] for t in tree])
    while len(tree) and node[:1].size and node.min() < len(tree):
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] >= values[node])
    return node - len(tree)


def box_distance(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from points (q x m) to boxes (b x m)."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d, None]
        gap = np.maximum(np.maximum(low[None, :, d] - p, p - high[None, :, d]), 0)
        out += gap * gap
    return out


def _block_leaves(points: np.ndarray) -> list[np.ndarray]:
    done, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            done.append(rows)
            continue
        part = points[rows]
        dim = int(np.argmax(part.max(0) - part.min(0)))
        order = np.argsort(part[:, dim], kind="stable")
        half = len(rows) // 2
        todo += [rows[order[:half]], rows[order[half:]]]
    return done


def search_block(ids, x, points, query_ids, q, query_points, bound, top: float, k: int, stop: float):
    """The k best (by score, then id) rows of a block for each query, as lists of (score, id).

    bound: score of the k-th best found elsewhere (-inf if none). top: M^2. stop: the chi-square quantile.
    """
    leaves = _block_leaves(points)
    low, high = np.stack([points[r].min(0) for r in leaves]), np.stack([points[r].max(0) for r in leaves])
    gap = box_distance(query_points, low, high)
    order = np.argsort(gap, axis=1, kind="stable")
    norm = np.einsum("ij,ij->i", q, q)
    kth = bound.copy()
    kth_id = np.full(len(q), np.iinfo(np.int64).max)
    best: list[list[tuple[float, int]]] = [[] for _ in range(len(q))]
    active = np.arange(len(q))
    for t in range(0, len(leaves), LEAVES):
        radius = stop * np.maximum(norm + top - 2 * kth, 0)           # infinite while fewer than k are known
        active = active[gap[active, order[active, t]] <= radius[active] * (1 + 1e-9)]
        if not len(active):
            break
        take = order[active, t: t + LEAVES]
        rows = np.repeat(active, take.shape[1])
        leaf = take.ravel()
        open_ = gap[rows, leaf] <= radius[rows] * (1 + 1e-9)
        rows, leaf = rows[open_], leaf[open_]
        by = np.argsort(leaf, kind="stable")
        rows, leaf = rows[by], leaf[by]
        for part in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(leaf)) + 1):
            if not len(part):
                continue
            who, points_of = rows[part], leaves[leaf[part[0]]]
            score = np.einsum("qd,nd->qn", q[who], x[points_of])      # equal rows get equal scores, to the last bit
            there = ids[points_of]
            good = (score > kth[who, None]) | ((score == kth[who, None]) & (there[None, :] < kth_id[who, None]))
            good &= there[None, :] != query_ids[who, None]
            for i in np.flatnonzero(good.any(1)):
                w = who[i]
                found = best[w] + list(zip(score[i, good[i]].tolist(), there[good[i]].tolist()))
                found.sort(key=lambda s: (-s[0], s[1]))
                best[w] = found[:k]
                if len(best[w]) == k and best[w][-1][0] >= kth[w]:
                    kth[w], kth_id[w] = best[w][-1]
    return best


def _matrix(column, width: int) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column]) if len(column) else np.zeros((0, width))


def usable(vectors: DataFrame, dim: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, v: array<double>) of the vectors that take part, one row per id, and their dimension."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), v).alias("v"))
    rows = rows.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    if dim is None:
        common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = common["d"] if common else 0
    return rows.where(F.size("v") == dim), dim


def nearest(vectors: DataFrame, is_query, k: int = 20, directions: int = 10, confidence: float = 0.97, seed: int = 1) -> DataFrame:
    """For each row where the condition ``is_query`` (on vec_id) holds, its k nearest other rows by inner product.

    Returns query_id, rank (from 1), vec_id and score (the inner product in
    double precision), nearest first, ties to the smaller vec_id; all
    candidates if there are fewer than k. Null ids and vectors, zero vectors
    and vectors with null or non-finite components take no part, nor do
    vectors of another length than the most frequent one. Of rows with one
    vec_id the one with the smallest vector counts. An empty table, or one
    without queries, gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows, dim = usable(vectors)
    rows = cut(rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    n, top = rows.agg(F.count(F.lit(1)), F.max("norm")).first()
    if not n:
        return spark.createDataFrame([], schema)
    rng = np.random.default_rng(seed)
    matrix = rng.standard_normal((dim + 1, directions))
    stop = chi2_quantile(confidence, directions)

    def project(v: np.ndarray, norm: np.ndarray | None) -> np.ndarray:
        p = v @ matrix[:dim]
        return p if norm is None else p + np.sqrt(np.maximum(top - norm, 0))[:, None] * matrix[dim]

    def flat(batch) -> np.ndarray:
        return batch.column("v").flatten().to_numpy().reshape(batch.num_rows, dim)

    def lists(a: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.shape[1], dtype=np.int32)), pa.array(a.ravel()))

    def sampled(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([lists(project(flat(b), b.column("norm").to_numpy()))], names=["p"])

    some = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(SAMPLE).select("v", "norm").mapInArrow(sampled, "p array<double>")
    leaves = 1
    while leaves < CELLS and leaves * ROWS < n:
        leaves *= 2
    tree = split_tree(numpy_columns(some)["p"].reshape(-1, directions), leaves)          # SAMPLE rows at most

    def indexed(batches):
        for b in batches:
            p = project(flat(b), b.column("norm").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), lists(p), pa.array(descend(p, tree).astype(np.int32))], names=["vec_id", "v", "p", "cell"])

    placed = cut(rows.select("vec_id", "v", "norm").mapInArrow(indexed, "vec_id long, v array<double>, p array<double>, cell int"))
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[f(F.col("p")[d]).alias(f"{f.__name__}{d}") for d in range(directions) for f in (F.min, F.max)]).collect()   # at most CELLS rows
    cells = np.array([r["cell"] for r in stats], np.int64)
    low = np.array([[r[f"min{d}"] for d in range(directions)] for r in stats])
    high = np.array([[r[f"max{d}"] for d in range(directions)] for r in stats])
    parts = {int(r["cell"]): -(-r["n"] // ROWS) for r in stats}
    parts_of = F.create_map(*[F.lit(x) for pair in sorted(parts.items()) for x in pair])
    placed = placed.withColumn("part", F.pmod(F.xxhash64("vec_id"), parts_of[F.col("cell")]).cast("int"))

    queries = cut(rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "v"))

    def route(bounded: DataFrame, home: bool) -> DataFrame:
        """(query_id, v, p, bound, cell, part): a row for each block that a query is sent to."""
        def send(batches):
            for b in batches:
                q = flat(b)
                p = project(q, None)
                bound = b.column("bound").to_numpy()
                gap = box_distance(p, low, high)
                if home:
                    who, where = np.arange(len(q)), gap.argmin(1)
                else:
                    radius = stop * np.maximum(np.einsum("ij,ij->i", q, q) + top - 2 * bound, 0)
                    who, where = np.nonzero(gap <= radius[:, None] * (1 + 1e-9))
                if len(who):
                    taken = b.take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([taken.column("query_id"), taken.column("v"), lists(p[who]), taken.column("bound"), pa.array(cells[where].astype(np.int32))],
                                                     names=["query_id", "v", "p", "bound", "cell"])
        sent = bounded.select("query_id", "v", "bound").mapInArrow(send, "query_id long, v array<double>, p array<double>, bound double, cell int")
        n_parts = parts_of[F.col("cell")]
        part = F.pmod(F.xxhash64("query_id"), n_parts).cast("int") if home else F.explode(F.sequence(F.lit(0), n_parts - 1))
        return sent.withColumn("part", part)

    def find(left_key: tuple, block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(asked):
            best = search_block(block["vec_id"].to_numpy(np.int64), _matrix(block["v"], dim), _matrix(block["p"], directions), asked["query_id"].to_numpy(np.int64),
                                _matrix(asked["v"], dim), _matrix(asked["p"], directions), asked["bound"].to_numpy(np.float64), top, k, stop)
            out = [(q, s[1], s[0]) for q, found in zip(asked["query_id"].tolist(), best) for s in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    def searched(sent: DataFrame) -> DataFrame:
        sent = cut(sent)
        load = {int(r["cell"]): -(-r["n"] // QUERIES) for r in sent.groupBy("cell", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(F.max("n").alias("n")).collect()}
        if not load:
            return spark.createDataFrame([], "query_id long, vec_id long, score double")
        chunks = F.create_map(*[F.lit(x) for pair in sorted(load.items()) for x in pair])
        blocks = placed.where(F.col("cell").isin(list(load))).withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks[F.col("cell")] - 1)))
        asked = sent.withColumn("chunk", F.pmod(F.xxhash64("query_id", F.lit(1)), chunks[F.col("cell")]).cast("int"))
        key = ["cell", "part", "chunk"]
        return (blocks.select(*key, "vec_id", "v", "p").groupBy(*key).cogroup(asked.select(*key, "query_id", "v", "p", "bound").groupBy(*key))
                .applyInPandas(find, "query_id long, vec_id long, score double"))

    first = searched(route(queries.withColumn("bound", F.lit(float("-inf"))), home=True))
    known = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    bounded = cut(queries.join(known, "query_id", "left").select("query_id", "v", F.coalesce("kth", F.lit(float("-inf"))).alias("bound")))
    found = searched(route(bounded, home=False))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

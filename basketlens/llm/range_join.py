"""Embedding near-dedup (operator 12): exact metric range join over pivot cells.

Two vectors of a label link if their cosine is at least a threshold, which is
a range join by angle, a metric: angle(x, y) <= reach = arccos(threshold).

1. Equal vectors of a label collapse, so a vector that a third of all rows
   repeat is one node from then on.
2. A label of many nodes is partitioned by pivots: ``split`` nodes a cell, so
   the number of cells follows the size of the label. A node's home is the cell
   of its nearest pivot. Pivots are fitted on a bounded sample (farthest first,
   so any first few of them are a good choice); every node is indexed.
3. The triangle inequality sets what lies on a cell's boundary. If x (home i)
   links with some y of home j, then angle(x, p_j) <= angle(x, p_i) + 2 reach,
   and angle(x, p_j) lies within ``reach`` of the angles that the nodes of home
   j have. x is copied to each lower-numbered cell for which both hold, which
   brings every pair together in exactly one cell.
4. Cells join independently: nodes at home with each other and with copies, in
   pairs of blocks of ``BLOCK`` nodes by matrix products in double precision. A
   task returns a row per node, its links and a local representative, never a
   row per pair.

Where the vectors of a label lie evenly in many dimensions all cells border on
each other; then every pair of the label's different vectors is compared, block
by block, and the result stays exact.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import broadcast_if_small, cut, numpy_columns
from basketlens.llm.components import components

SAMPLE = 16_384       # nodes that the pivots are chosen from
PIVOTS = 1024         # most cells of a label
SPLIT = 2048          # nodes a cell that a label's number of cells aims at
BLOCK = 1024          # nodes of a block: a task holds two blocks and a matrix of their cosines
SLACK = 1e-7          # added to angles, so that rounding never drops a pair before it is verified
MAX_BROADCAST = 200_000


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """At most ``count`` different unit vectors, each as far as possible from those before it."""
    out = [int(np.lexsort(points.T[::-1])[0])]
    near = points @ points[out[0]]
    while len(out) < min(count, len(points)):
        k = int(np.argmin(near))
        if near[k] > 1 - 1e-9:
            break
        out.append(k)
        near = np.maximum(near, points @ points[k])
    return points[out]


def local_labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row connected to each of ``n`` rows by the links i - j."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of x, row of y) with cosine >= threshold; x and y hold rows of length 1.

    Products that meet the threshold to 1e-12 are summed once more without rounding, so the decision does not depend on
    how rows are put into blocks.
    """
    left, right = [], []
    for a in range(0, len(x), 256):
        c = x[a: a + 256] @ y.T
        i, j = np.nonzero(c >= threshold - 1e-12)
        sure = c[i, j] > threshold + 1e-12
        for k in np.flatnonzero(~sure):
            sure[k] = math.fsum(x[a + i[k]] * y[j[k]]) >= threshold
        left.append(i[sure] + a)
        right.append(j[sure])
    return np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64)


def _join(threshold: float):
    def block_pair(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        """One pair of blocks: links and local representative of its nodes."""
        left, right = key[-2], key[-1]
        pdf = pdf.sort_values("block", ignore_index=True, kind="stable")
        x = np.stack(pdf["unit"].to_numpy())
        n = int((pdf["block"] == left).sum())
        if left == right:
            i, j = linked(x, x, threshold)
            i, j = i[i < j], j[i < j]
        else:
            i, j = linked(x[:n], x[n:], threshold)
            j = j + n
        copies = pdf["copies"].to_numpy(np.int64)
        links = np.zeros(len(pdf), np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        node = pdf["node"].to_numpy()
        rep = node[local_labels(len(pdf), i, j)]
        return pd.DataFrame({"node": node, "rep": rep, "links": links})[links > 0]
    return block_pair


def _rows_of(batch: pa.RecordBatch, pivots: dict[int, np.ndarray]):
    """(rows, their vectors, the pivots of their cells) for the rows of each dimension and number of cells above one."""
    lists, cells = batch.column("unit"), batch.column("cells").to_numpy()
    sizes = lists.value_lengths().to_numpy()
    flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
    for size, count in sorted(set(zip(sizes.tolist(), cells.tolist()))):
        if size in pivots and min(count, len(pivots[size])) > 1:
            rows = np.flatnonzero((sizes == size) & (cells == count))
            yield rows, flat[(ends[rows][:, None] + np.arange(size)).ravel()].reshape(len(rows), size), pivots[size][:count], (size, count)


def _placer(pivots: dict[int, np.ndarray]):
    """Home cell of each node, and the angle to its pivot."""
    def place(batches):
        for b in batches:
            home, angle = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for rows, x, p, _ in _rows_of(b, pivots):
                c = x @ p.T
                home[rows] = c.argmax(1)
                angle[rows] = np.arccos(np.clip(c[np.arange(len(rows)), home[rows]], -1, 1))
            yield pa.RecordBatch.from_arrays([b.column("dim"), b.column("cells"), pa.array(home), pa.array(angle)], names=["dim", "cells", "home", "angle"])
    return place


def _router(pivots: dict[int, np.ndarray], ring: dict[tuple[int, int, int], tuple[float, float]], reach: float):
    """Cells that a node goes to: its home, and the lower-numbered ones on whose boundary it lies."""
    def route(batches):
        for b in batches:
            home = np.zeros(b.num_rows, np.int32)
            who, where = [np.arange(b.num_rows)], [home]
            for rows, x, p, key in _rows_of(b, pivots):
                c = x @ p.T
                home[rows] = c.argmax(1)
                far = np.arccos(np.clip(c, -1, 1))
                low, high = np.array([ring.get((*key, j), (9.0, -9.0)) for j in range(len(p))]).T
                near = far[np.arange(len(rows)), home[rows]]
                border = (far <= near[:, None] + 2 * reach + SLACK) & (far >= low - reach - SLACK) & (far <= high + reach + SLACK)
                i, j = np.nonzero(border & (np.arange(len(p))[None, :] < home[rows][:, None]))
                who.append(rows[i])
                where.append(j.astype(np.int32))
            who, where = np.concatenate(who), np.concatenate(where)
            taken = b.take(pa.array(who))
            yield pa.RecordBatch.from_arrays([*[taken.column(c) for c in ("node", "label", "dim", "copies", "unit")], pa.array(where), pa.array(where == home[who])],
                                             names=["node", "label", "dim", "copies", "unit", "cell", "inner"])
    return route


def _named(batches):
    """Vectors at length 1 (the largest component is taken out first, so no square overflows or vanishes), named by a
    128-bit digest of label and vector; both are null where the vector takes no part."""
    for b in batches:
        v = b.column("v")
        has = v.is_valid().to_numpy(zero_copy_only=False)
        sizes = np.where(has, v.value_lengths().fill_null(0).to_numpy(), 0)
        flat, ends = v.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
        rows = np.flatnonzero(has)
        node: list[bytes | None] = [None] * b.num_rows
        for i, label in zip(rows.tolist(), b.column("label").take(pa.array(rows)).to_pylist()):
            node[i] = hashlib.blake2b(flat[ends[i]: ends[i + 1]].tobytes(), digest_size=16, key=hashlib.blake2b(label.encode(), digest_size=16).digest()).digest()
        if len(rows):
            flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), ends[rows]), sizes[rows])
            flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, ends[rows])), sizes[rows])
        unit = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(node, pa.binary()), pa.array(sizes.astype(np.int32)), unit],
                                         names=["vec_id", "label", "node", "dim", "unit"])


def near_vectors(vectors: DataFrame, threshold: float = 0.93, split: int = SPLIT, seed: int = 12) -> DataFrame:
    """Near-duplicate classes of ``vectors(vec_id, label, embedding)``: a row per input row.

    Returns vec_id, n_links (other rows of the same label, and the same number
    of components, whose cosine in double precision is >= threshold),
    component_id (smallest vec_id reachable by links, its own included) and
    kept (vec_id = component_id). ``threshold`` lies in (-1, 1].

    Rows whose label or vector is null, and vectors that are empty, zero or hold
    null or non-finite components link with nothing: n_links 0, component_id =
    vec_id, kept. Rows that repeat are vectors of their own, linked with each
    other; those that share the smallest vec_id of a component are all kept. A
    null vec_id is a row as any other; it is the component's id only if all of
    its vec_ids are null. An empty table gives an empty result. Other columns,
    whatever their names, are not read.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(usable, F.transform(v, lambda x: x + 0.0)).alias("v"))   # -0.0 + 0.0 is 0.0
    named = rows.mapInArrow(_named, "vec_id long, label string, node binary, dim int, unit array<double>")
    nodes = cut(named.where("node is not null").groupBy("node").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"), F.any_value("label").alias("label"), F.any_value("dim").alias("dim"), F.any_value("unit").alias("unit")))

    cells = F.pow(F.lit(2), F.ceil(F.log2(F.count(F.lit(1)) / split)))                 # a power of two, so that few numbers of cells occur
    wanted = nodes.groupBy("label", "dim").agg(F.least(F.lit(PIVOTS), cells).cast("int").alias("cells")).where("cells > 1")
    wanted = broadcast_if_small(cut(wanted), MAX_BROADCAST)
    some = nodes.join(wanted, ["label", "dim"], "left_semi").orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(SAMPLE).select("dim", "unit")
    sample = numpy_columns(some)                                                       # SAMPLE rows at most
    at = np.concatenate([[0], np.cumsum(sample["dim"])]).astype(np.int64)
    pivots = {}                                                                        # a label of a dimension that the sample missed has one cell, in blocks
    for size in sorted(set(sample["dim"].tolist())):
        mine = np.flatnonzero(sample["dim"] == size)
        pivots[size] = farthest_first(sample["unit"][(at[mine][:, None] + np.arange(size)).ravel()].reshape(len(mine), size), PIVOTS)
    sized = nodes.join(wanted, ["label", "dim"], "left").select("node", "label", "dim", "copies", "unit", F.coalesce("cells", F.lit(1)).alias("cells"))
    ring = {}
    if pivots:                                                                         # at most 2 * PIVOTS rows for each dimension of the sample
        homes = sized.where("cells > 1").mapInArrow(_placer(pivots), "dim int, cells int, home int, angle double")
        ring = {(d, c, h): (low, high) for d, c, h, low, high in homes.groupBy("dim", "cells", "home").agg(F.min("angle"), F.max("angle")).collect()}
    reach = math.acos(max(-1.0, min(1.0, threshold)))
    routed = sized.mapInArrow(_router(pivots, ring, reach), "node binary, label string, dim int, copies long, unit array<double>, cell int, inner boolean")

    cell = ["label", "dim", "cell"]
    blocks = routed.groupBy(*cell).agg(*[F.ceil(F.count_if(c) / BLOCK).cast("int").alias(k) for k, c in (("bi", F.col("inner")), ("bo", ~F.col("inner")))], F.count(F.lit(1)).alias("n"))
    blocks = broadcast_if_small(cut(blocks.where("bi > 0 and n > 1").drop("n")), MAX_BROADCAST)
    number = F.xxhash64(F.lit(seed + 1), "node")
    block = F.when(F.col("inner"), F.pmod(number, F.col("bi"))).otherwise(F.col("bi") + F.pmod(number, F.greatest("bo", F.lit(1)))).cast("int")
    pairs = F.expr("""if(inner,
        concat(transform(sequence(block, bi + bo - 1), x -> struct(block as l, x as r)),
               transform(slice(sequence(0, block), 1, block), x -> struct(x as l, block as r))),
        transform(sequence(0, bi - 1), x -> struct(x as l, block as r)))""")
    asked = routed.join(blocks, cell).withColumn("block", block).select(*cell, F.explode(pairs).alias("p"), "block", "node", "copies", "unit")
    key = [*cell, "l", "r"]
    found = cut(asked.select(*cell, "p.l", "p.r", "block", "node", "copies", "unit").repartition(*key).groupBy(*key)
                .applyInPandas(_join(threshold), "node binary, rep binary, links long"))

    comps = components(found.where("node != rep").select(F.col("rep").alias("u"), F.col("node").alias("v")).distinct())
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    info = nodes.select("node", "first", "copies").join(comps, "node", "left").join(links, "node", "left").select(
        "node", "first", F.coalesce("comp", "node").alias("comp"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    heads = info.groupBy("comp").agg(F.min("first").alias("component_id"))
    info = info.join(heads, "comp").select("node", "n_links", "component_id")
    out = named.select("vec_id", "node").join(info, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

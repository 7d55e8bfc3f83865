"""Connected components of an edge table, as rounds of DataFrame joins (nothing is collected but whether edges are left)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import stored


def _placed(seed: int, node: str) -> Column:
    """A node with its place in the order of round ``seed``: by a seeded hash, then by the node itself."""
    return F.struct(F.xxhash64(F.lit(seed), node).alias("place"), F.col(node).alias("node"))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``edges(u, v)`` that has another node beside it; comp is the smallest node of its component.

    Each round orders the nodes anew by a seeded hash, gives every node that
    still has edges the first node next to it (or itself), then that one's,
    and contracts the edges to those parents. Whatever the nodes' own order, a
    round leaves a constant share of the nodes on average (a star vanishes in
    one round, of a long chain about four in ten nodes stay), so the number of
    rounds follows the logarithm of the longest chain. Rounds end when no edge
    is left. Each round's parents and edges are written and read back, so a
    round's plan is as short as the first one's. At the end the parents are
    followed from the last round to the first, each table a fraction of the
    one before. A hub's edges are combined before the shuffle, and its rows
    can be split in the joins.
    """
    left = stored(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u != v").distinct())
    parents: list[DataFrame] = []
    while left.limit(1).count():
        seed = len(parents)
        ends = left.select(F.col("u").alias("node"), F.col("v").alias("other")).union(left.select(F.col("v").alias("node"), F.col("u").alias("other")))
        low = ends.groupBy("node").agg(F.min(_placed(seed, "other")).alias("low"))
        near = low.select("node", F.least("low", _placed(seed, "node"))["node"].alias("up"))
        over = near.select(F.col("node").alias("up"), F.col("up").alias("parent"))
        parent = stored(near.join(over, "up").select("node", "parent"))
        parents.append(parent)
        a, b = parent.withColumnsRenamed({"node": "u", "parent": "a"}), parent.withColumnsRenamed({"node": "v", "parent": "b"})
        met = left.join(a, "u").join(b, "v").where("a != b")
        left = stored(met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if not parents:
        return left.select(F.col("u").alias("node"), F.col("u").alias("comp"))
    label = parents.pop()
    while parents:
        label = stored(parents.pop().join(label.select(F.col("node").alias("parent"), F.col("parent").alias("root")), "parent", "left")
                       .select("node", F.coalesce("root", "parent").alias("parent")))
    first = label.groupBy("parent").agg(F.min("node").alias("comp"))
    return label.join(first, "parent").select("node", "comp")

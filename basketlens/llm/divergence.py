"""Source divergence audit (operator 13): a frequent-pattern tree of term rows.

For each language the kept terms (those in at least ``min_docs`` of its
documents) get a smoothed share in every source, and sources are compared by
the sum of absolute differences of shares over all kept terms.

Most terms occur in few sources, so a pair's sum is split into parts that need
no row per term and pair. With p and q a term's shares in sources s and t, and
z_s, z_t the shares of a term that does not occur,

  sum |p - q| = V |z_s - z_t|
              + sum over terms of s (|p - z_t| - |z_s - z_t|)
              + sum over terms of t (|z_s - q| - |z_s - z_t|)
              + sum over terms of both (|p - q| - |p - z_t| - |z_s - q| + |z_s - z_t|).

The second and third sums need a histogram of each source's shares only. The
last one comes from the tree: a term's row is the list of its sources with
their nonzero counts, most widespread source first; equal rows become one with
a multiplicity; rows are inserted in order, so those that begin alike share a
path. A node adds its multiplicity times the correction of the pair (ancestor,
node) once for each of its ancestors.

Spark counts the terms, groups equal rows and sorts the rows by range; a task
streams its rows and holds one path of the tree and one sum per pair of
sources it met, handed on beyond ``HELD`` pairs. A path that is cut where two
tasks meet adds up to the same sums, as corrections are linear in multiplicity.
All arithmetic is on integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.llm.common import broadcast_if_small, cut

SCALE = 1_000_000_000
SLICE = 1 << 20          # bytes of a text that are split into terms at a time
TERMS = 200_000          # counters that a task holds before it hands them on
HELD = 500_000           # pairs of sources that a task holds before it hands their sums on
MAX_BROADCAST_GROUPS = 20_000

#: A-Z become a-z, other ASCII characters blanks; bytes of non-ASCII characters stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def slices(raw: bytes, size: int = SLICE):
    """Pieces of about ``size`` bytes, cut at blanks; a longer term stays whole."""
    a = 0
    while a < len(raw):
        b = len(raw) if a + size >= len(raw) else raw.rfind(b" ", a, a + size) + 1
        if b <= a:                                     # no blank in the piece
            b = raw.find(b" ", a + size) + 1 or len(raw)
        yield raw[a:b]
        a = b


def _term_counts(batches):
    """(lang, source, term, n occurrences, d documents), combined over many documents of a task."""
    held: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    size = 0

    def rows():
        for (lang, source), (n, d) in held.items():
            names = [pa.array([x], pa.binary()).take(pa.array(np.zeros(len(n), np.int64))) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())],
                                             names=["lang", "source", "term", "n", "d"])

    for batch in batches:
        for text, lang, source in zip(*(batch.column(c) for c in ("text", "lang", "source"))):
            one: Counter = Counter()
            for piece in slices(text.as_py().translate(_TABLE)):
                one.update(piece.split())
            if one:
                n, d = held[lang.as_py(), source.as_py()]
                before = len(n)
                n.update(one)
                d.update(one.keys())
                size += len(n) - before
                if size > TERMS:
                    yield from rows()
                    held.clear()
                    size = 0
    yield from rows()


class Path:
    """The open path of a tree whose rows come in order, and the corrections of its closed nodes."""

    def __init__(self):
        self.ord, self.p, self.z, self.times = np.zeros(64, np.int64), np.zeros(64, np.int64), np.zeros(64, np.int64), []
        self.pairs: list[np.ndarray] = []
        self.values: list[np.ndarray] = []
        self.size = 0

    def insert(self, order: np.ndarray, p: np.ndarray, z: np.ndarray, times: int) -> None:
        n, depth = len(order), len(self.times)
        most = min(n, depth)
        differ = np.flatnonzero((order[:most] != self.ord[:most]) | (p[:most] != self.p[:most]))
        shared = int(differ[0]) if len(differ) else most
        self.close(shared)
        if n > len(self.ord):
            self.ord, self.p, self.z = (np.concatenate([x, np.zeros(n, np.int64)]) for x in (self.ord, self.p, self.z))
        for mine, new in ((self.ord, order), (self.p, p), (self.z, z)):
            mine[shared:n] = new[shared:]
        self.times += [0] * (n - shared)
        self.times[n - 1] += times

    def close(self, depth: int) -> None:
        """Close the nodes below ``depth``: each meets its ancestors once, with all the rows that passed it."""
        while len(self.times) > depth:
            times, k = self.times.pop(), len(self.times)
            if k:
                p, z, above, zero = self.p[k], self.z[k], self.p[:k], self.z[:k]
                self.pairs.append((self.ord[:k] << 32) | self.ord[k])
                self.values.append(times * (np.abs(above - p) - np.abs(above - z) - np.abs(zero - p) + np.abs(zero - z)))
                self.size += k
                self.times[-1] += times

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """(pair, sum) so far, as one entry a pair."""
        if not self.pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair, back = np.unique(np.concatenate(self.pairs), return_inverse=True)
        total = np.zeros(len(pair), np.int64)
        np.add.at(total, back, np.concatenate(self.values))
        self.pairs, self.values, self.size = [pair], [total], len(pair)
        return pair, total


def _tree(batches):
    """(lang, a, b, value): corrections of pairs of sources (by their order), from term rows sorted by lang and row."""
    lang, path, limit = None, Path(), 4 * HELD

    def rows():
        pair, total = path.sums()
        if len(pair):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(pair), pa.string()), pa.array((pair >> 32).astype(np.int32)), pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(total)],
                                             names=["lang", "a", "b", "value"])

    for batch in batches:
        sizes = batch.column("ord").value_lengths().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        order, p, z = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("ord", "p", "z"))
        for i, (name, times) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("times").to_pylist())):
            if name != lang:
                path.close(0)
                yield from rows()
                lang, path = name, Path()
            path.insert(*(x[ends[i]: ends[i + 1]] for x in (order, p, z)), times)
            if path.size > limit:
                if len(path.sums()[0]) > HELD:
                    yield from rows()
                    path.pairs, path.values, path.size = [], [], 0
    path.close(0)
    yield from rows()


def _share(count, total, terms) -> Column:
    """1 + floor(SCALE (count + 5) / (total + 5 terms)) on exact integers of any size."""
    wide = lambda c: c.cast("decimal(19,0)")
    return (F.lit(1) + F.floor(_div(F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + F.lit(5)), wide(total) + F.lit(5) * wide(terms)))).cast("long")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def audit(docs: DataFrame, min_docs: int = 30, term_ranks: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank of ``docs(text, lang, source)``; null text, lang and source read as ''.

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased. A
    language keeps the V terms in at least ``min_docs`` of its documents (rows;
    rows that repeat count as often). A term's share in a source or language
    is 1 + floor(10^9 (count + 5) / (N + 5 V)), N being the sum of counts of
    kept terms there. Part "pair": the sum over all kept terms of the absolute
    difference of shares between the source and every other source (item) of
    the language, 0 if V is 0. Part "term": the kept terms that occur in the
    source with a larger share than in the language, by the difference, ranks
    up to ``term_ranks``. rank: by value, largest first, ties by item.

    Texts of any length are read whole, in slices. A source without kept terms
    has pairs, but no terms; a language of one source has no pairs. An empty
    table gives an empty result. Other columns, whatever their names, are not read.
    """
    empty = F.lit("")
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("text", "lang", "source")])
    binary = read.select(*[F.col(c).cast("binary").alias(c) for c in ("text", "lang", "source")])
    counted = binary.mapInArrow(_term_counts, "lang binary, source binary, term binary, n long, d long")
    # dealt by language and term at once: both groupings below find their rows in place
    counts = counted.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "n", "d").repartition("lang", "term")
    counts = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    terms = (counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("row"))
             .where(F.col("d") >= min_docs))
    terms = cut(terms.select("lang", "term", "total", "row"))                     # a list holds an entry for each source of the term

    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("all"))
    sums = terms.select("lang", F.explode("row").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("n"), F.count(F.lit(1)).alias("wide"))
    info = read.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n", "wide", "v", "all"])
    info = info.withColumn("ord", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("wide"), "source")))       # a row per source
    zero = F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.col("v"))).otherwise(F.lit(0))
    info = cut(info.select("lang", "source", "ord", F.col("n").alias("sum"), "v", "all", zero.alias("z")))
    near = broadcast_if_small(info, MAX_BROADCAST_GROUPS)

    items = terms.select("lang", "term", "total", F.explode("row").alias("x")).select("lang", "term", "total", "x.source", "x.n").join(near, ["lang", "source"])
    items = cut(items.select("lang", "source", "ord", "term", "z", _share(F.col("n"), F.col("sum"), F.col("v")).alias("p"), _share(F.col("total"), F.col("all"), F.col("v")).alias("q")))

    # part "pair": four contributions per pair of sources, of which the last comes from the tree
    rows = items.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("ord", "p", "z"))).alias("row")).where(F.size("row") > 1)
    rows = cut(rows.groupBy("lang", "row").agg(F.count(F.lit(1)).alias("times")))
    ordered = rows.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row")
    tree = ordered.select("lang", *[F.col(f"row.{c}").alias(c) for c in ("ord", "p", "z")], "times").mapInArrow(_tree, "lang string, a int, b int, value long")

    salt = 16                                                                     # a language may hold most sources
    other = info.select("lang", F.col("ord").alias("b"), F.col("z").alias("zb"), F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("salt"))
    other = broadcast_if_small(other, salt * MAX_BROADCAST_GROUPS)
    salted = lambda df: df.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salt)).cast("int")).join(other, ["lang", "salt"]).where("a != b")
    base = salted(info.select("lang", F.col("ord").alias("a"), "z", "v")).select("lang", "a", "b", (F.col("v") * F.abs(F.col("z") - F.col("zb"))).alias("value"))
    histogram = items.groupBy("lang", F.col("ord").alias("a"), "z", "p").agg(F.count(F.lit(1)).alias("times"))
    one = salted(histogram).groupBy("lang", "a", "b").agg(F.sum(F.col("times") * (F.abs(F.col("p") - F.col("zb")) - F.abs(F.col("z") - F.col("zb")))).alias("value"))
    both = one.unionByName(tree)
    both = both.unionByName(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    pairs = base.unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    names = broadcast_if_small(info.select("lang", "ord", "source"), MAX_BROADCAST_GROUPS)
    pairs = pairs.join(names.withColumnRenamed("ord", "a"), ["lang", "a"]).join(names.select("lang", F.col("ord").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))

    over = items.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    over = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= term_ranks)
    out = pairs.withColumn("part", F.lit("pair")).unionByName(over.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")

"""Exact linear-interpolation quantiles with numpy's arithmetic.

Spark's ``percentile`` interpolates as ``(hi_pos - pos) * lo + (pos - lo_pos) * hi``;
numpy (and so pandas ``quantile``) uses the virtual index ``(n - 1) * q`` and ``lo + (hi - lo) * t`` (``hi - (hi - lo) * (1 - t)`` when ``t >= 0.5``). The
results can differ in the last bit, so this module finds the two order
statistics and applies numpy's formula.

Plan: a group-by gives the distinct values with their counts (map-side
combined). Approximate borders (``percentile_approx`` over the distinct
values) cut them into value ranges; counts per range and their running sum (a
row per range) tell in which ranges the wanted order statistics lie, and only
inside those does a running count locate them, a task per range. So no task
sees all distinct values, however many there are, and the result is exact
wherever the borders fall. Everything is one lazy plan: borders are a scalar
subquery, the ranges' row counts a broadcast of at most ``buckets`` rows, and
the grouped values are one exchange that its readers share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _virtual(q: float) -> Column:
    """numpy's virtual index of a quantile among ``n`` values."""
    return (F.col("n") - F.lit(1)).cast("double") * F.lit(float(q))


def _ranks(q: float) -> tuple[Column, Column]:
    """The two 0-based ranks that a quantile lies between."""
    prev = F.least(F.greatest(F.floor(_virtual(q)), F.lit(0)), F.col("n") - 1)
    return prev, F.least(prev + 1, F.col("n") - 1)


def exact_quantiles(df: DataFrame, col: str, qs: dict[str, float], buckets: int = 128) -> DataFrame:
    """One row with one column per name in ``qs``: the ``q`` quantile of ``col`` (nulls skipped)."""
    vals = df.select(F.col(col).cast("double").alias("v")).dropna()
    hist = vals.groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    steps = [i / buckets for i in range(1, buckets)]
    borders = hist.agg(F.percentile_approx("v", steps, 100 * buckets).alias("b")).scalar()
    ranged = hist.withColumn("_borders", borders)
    below = F.filter("_borders", lambda x: x < F.col("v"))
    ranged = ranged.withColumn("bucket", F.size(below)).drop("_borders")
    sizes = ranged.groupBy("bucket").agg(F.sum("k").alias("rows"))                    # at most ``buckets`` rows
    upto = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = sizes.withColumns({"last": F.sum("rows").over(upto), "n": F.sum("rows").over(Window.partitionBy())})
    ranks = [r for q in qs.values() for r in _ranks(q)]
    here = F.lit(False)
    for r in ranks:
        here = here | ((F.col("last") - F.col("rows") <= r) & (r < F.col("last")))
    wanted = sizes.filter(here).select("bucket", (F.col("last") - F.col("rows")).alias("before"), "n")
    run = Window.partitionBy("bucket").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # value v covers the 0-based ranks [upto - k, upto); n = number of values
    hist = ranged.join(F.broadcast(wanted), "bucket").withColumn("upto", F.col("before") + F.sum("k").over(run))
    aggs: list[Column] = []
    for name, q in qs.items():
        vi = _virtual(q)
        prev, nxt = _ranks(q)
        lo_rank = F.col("upto") - F.col("k")
        aggs += [F.min(F.when((lo_rank <= prev) & (prev < F.col("upto")), F.col("v"))).alias(f"{name}__lo"),
                 F.min(F.when((lo_rank <= nxt) & (nxt < F.col("upto")), F.col("v"))).alias(f"{name}__hi"),
                 F.min(vi - F.floor(vi)).alias(f"{name}__t")]
    row = hist.agg(*aggs)
    out = []
    for name in qs:
        lo, hi, t = F.col(f"{name}__lo"), F.col(f"{name}__hi"), F.col(f"{name}__t")
        d = hi - lo
        out.append(F.when(t >= 0.5, hi - d * (F.lit(1.0) - t)).otherwise(lo + d * t).alias(name))
    return row.select(*out)

"""Distinct counts that merge (A14, A18): monthly HyperLogLog sketches beside exact monthly sums.

An order is counted once per year or gender however its lines are spread over
months and exports, so monthly distinct counts cannot be added; monthly
sketches can be united. The partials hold a row per (year, month, gender),
are stored once, and answer any period without reading the lines again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.columns import as_double, sum0

#: log2 of a sketch's buckets: one standard error of a united sketch is 1.04 / sqrt(2 ** LG_K), here 0.8 %.
LG_K = 14


def relative_error(lg_k: int = LG_K, deviations: float = 3.0) -> float:
    """Bound of a united sketch's relative error at so many standard deviations."""
    return deviations * 1.04 / (2 ** lg_k) ** 0.5


def monthly_partials(lines: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(year, month, gender): revenue, discount, and sketches of all and of discounted order numbers.

    A map-side-combined aggregate: a shuffle carries a sketch per task and
    group, never order numbers. Null order numbers are in no sketch; a group
    without discounted orders has a null sketch of them.
    """
    order = F.col("order_number").cast("string")
    discounted = F.when(F.col("discount_amount") > 0, order)
    return lines.groupBy("year", "month", "gender").agg(
        sum0("line_revenue").alias("revenue"), F.sum(F.when(F.col("discount_amount") > 0, F.col("discount_amount"))).alias("discount"),
        F.hll_sketch_agg(order, lg_k).alias("orders"), F.hll_sketch_agg(discounted, lg_k).alias("discounted"))


def merge_partials(parts: DataFrame, *more: DataFrame) -> DataFrame:
    """One table of partials from several (new months, late lines of old ones): sums add, sketches unite."""
    for other in more:
        parts = parts.unionByName(other)
    return parts.groupBy("year", "month", "gender").agg(
        F.sum("revenue").alias("revenue"), F.sum("discount").alias("discount"),
        F.hll_union_agg("orders").alias("orders"), F.hll_union_agg("discounted").alias("discounted"))


def _estimate(sketch: str) -> Column:
    return F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(sketch)), F.lit(0)).cast("long")


def discount_summary(parts: DataFrame) -> DataFrame:
    """A14 from the partials: exact discount, estimated number of discounted orders per year."""
    return (parts.filter(F.col("year").isNotNull()).groupBy("year")
            .agg(as_double(F.sum("discount")).alias("discount_total"), _estimate("discounted").alias("discounted_orders"))
            .filter(F.col("discount_total").isNotNull()))


def gender_summary(parts: DataFrame) -> DataFrame:
    """A18 from the partials: estimated number of orders, exact revenue per gender."""
    return (parts.filter(F.col("gender").isNotNull()).groupBy("gender")
            .agg(_estimate("orders").alias("orders"), as_double(F.sum("revenue")).alias("revenue")))


def against_exact(estimated: DataFrame, exact: DataFrame, key: str, count: str, lg_k: int = LG_K) -> DataFrame:
    """``exact`` with ``within``: whether the estimated count lies within the stated error (half an order at least)."""
    est = estimated.select(key, F.col(count).alias("_estimate"))
    bound = F.greatest(F.col(count) * F.lit(relative_error(lg_k)), F.lit(0.5))
    return exact.join(est, key).withColumn("within", F.abs(F.col("_estimate") - F.col(count)) <= bound).drop("_estimate")

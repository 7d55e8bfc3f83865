"""Yearly discounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.columns import as_double


def discount_summary(lines: DataFrame) -> DataFrame:
    """F5 + A14: Σ discount and number of distinct discounted orders per year.

    Two-level aggregation instead of ``countDistinct``: (year, order) first,
    so each shuffle carries partial sums, and the per-year step counts the
    non-null order numbers of a frame that is already distinct.
    """
    per_order = (lines.filter((F.col("discount_amount") > 0) & F.col("year").isNotNull())
                 .groupBy("year", "order_number").agg(F.sum("discount_amount").alias("discount")))
    return per_order.groupBy("year").agg(
        as_double(F.sum("discount")).alias("discount_total"),
        F.count("order_number").alias("discounted_orders"))

"""Audience reports: gender (R9) and origin (R10) shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.columns import as_double, format_share
from basketlens.operators.periods import from_year
from basketlens.operators.ranking import fold_small_shares, value_shares
from basketlens.schema import Params


def gender_share(lines: DataFrame) -> DataFrame:
    """Share of order lines per gender in % (nulls outside the denominator)."""
    return value_shares(lines, "gender")


def gender_summary(lines: DataFrame) -> DataFrame:
    """Distinct orders and Σ line revenue per gender (two-level aggregation)."""
    per_order = (lines.filter(F.col("gender").isNotNull())
                 .groupBy("gender", "order_number").agg(F.sum("line_revenue").alias("revenue")))
    return per_order.groupBy("gender").agg(
        F.count("order_number").alias("orders"),
        as_double(F.coalesce(F.sum("revenue"), F.lit(0))).alias("revenue"))


def origin_share(lines: DataFrame, params: Params = Params()) -> DataFrame:
    """F6 + A19: share of order lines per origin from ``origin_min_year`` on."""
    return value_shares(from_year(lines, params.origin_min_year), "origin")


def origin_folded(lines: DataFrame, params: Params = Params()) -> DataFrame:
    """Origin shares with those under ``share_threshold`` folded into one row."""
    return fold_small_shares(origin_share(lines, params), "origin", params.share_threshold, params.other_label)


def shares_text(shares: DataFrame, key: str) -> DataFrame:
    """P12 + K9: rank, key and share as printed ("12.34%"), most frequent first, ties by the key.

    The window orders one row per distinct value, as the printed list does.
    """
    order = Window.orderBy(F.desc("n"), F.asc(key))
    return shares.select(F.row_number().over(order).alias("rank"), key, format_share("share").alias("share"))


__all__ = ["gender_share", "gender_summary", "origin_folded", "origin_share", "shares_text"]

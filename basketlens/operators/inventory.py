"""Stock risks (R6): trailing-year item sales, quantile thresholds, risk lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.functions.columns import first_non_null, sum0
from basketlens.functions.materialise import reliable
from basketlens.functions.quantiles import exact_quantiles
from basketlens.operators.periods import trailing_days
from basketlens.operators.ranking import head_with_remainder
from basketlens.schema import Params


def item_sales(lines: DataFrame, params: Params = Params()) -> DataFrame:
    """F3 + A12 + P10: quantity sold in the trailing window, first stock level, daily average."""
    recent = trailing_days(lines, params.as_of, params.trailing_days)
    agg = (recent.filter(F.col("item_id").isNotNull() & F.col("item_name").isNotNull())
           .groupBy("item_id", "item_name")
           .agg(sum0("quantity").cast("double").alias("quantity"),
                first_non_null("stock_quantity", recent).alias("stock_quantity")))
    return agg.withColumn("daily_avg", F.col("quantity") / F.lit(float(params.trailing_days)))


def stock_thresholds(items: DataFrame, params: Params = Params()) -> DataFrame:
    """High and low quantile of the daily average (linear interpolation, nulls skipped).

    Exact by default, with the reference's (numpy's) interpolation arithmetic;
    ``approx_quantiles`` switches to Spark's fixed-size quantile sketch.
    """
    if params.approx_quantiles:
        return items.agg(
            F.percentile_approx("daily_avg", params.high_quantile, params.approx_accuracy).alias("q_high"),
            F.percentile_approx("daily_avg", params.low_quantile, params.approx_accuracy).alias("q_low"))
    return exact_quantiles(items, "daily_avg", {"q_high": params.high_quantile, "q_low": params.low_quantile})


def stock_flags(items: DataFrame, params: Params = Params()) -> DataFrame:
    """F7/F8 as boolean columns. The thresholds are scalar subqueries (one row,
    computed once and inlined as values), so there is no join. Comparisons
    with null count as false."""
    th = stock_thresholds(items, params).select(F.struct("q_high", "q_low")).scalar()
    items = items.withColumn("_th", th)     # one subquery, read twice below
    q_high, q_low = F.col("_th.q_high"), F.col("_th.q_low")
    d, s = F.col("daily_avg"), F.col("stock_quantity")
    low = (d > q_high) & (s < d * F.lit(params.low_stock_days))
    excess = (d <= q_low) & (s > d * F.lit(params.excess_stock_days))
    return items.withColumns({"low_stock": F.coalesce(low, F.lit(False)),
                              "excess_stock": F.coalesce(excess, F.lit(False))}).drop("_th")


_COLS = ["item_id", "item_name", "quantity", "daily_avg", "stock_quantity"]


def low_stock(flags: DataFrame) -> DataFrame:
    """F7 rows (K6 order: daily average descending, then item id, name)."""
    return flags.filter("low_stock").select(*_COLS)


def excess_stock(flags: DataFrame) -> DataFrame:
    """F8 rows (K6 order: daily average ascending, then item id, name)."""
    return flags.filter("excess_stock").select(*_COLS)


def low_order() -> list[Column]:
    return [F.desc("daily_avg"), F.asc("item_id"), F.asc("item_name")]


def excess_order() -> list[Column]:
    return [F.asc("daily_avg"), F.asc("item_id"), F.asc("item_name")]


def low_stock_head(flags: DataFrame, params: Params = Params()) -> DataFrame:
    """K5: first rows of the low-stock list and how many more there are.

    The risk list is materialised once (``reliable``: checkpoint or persist),
    because the head and the remainder count both read it; otherwise each
    would recompute the item sales and the thresholds. Already cached flags
    (as in the R6 report) are read directly.
    """
    return head_with_remainder(_shared(low_stock(flags), flags), low_order(), params.head_rows)


def excess_stock_head(flags: DataFrame, params: Params = Params()) -> DataFrame:
    """K5 for the excess-stock list (see ``low_stock_head``)."""
    return head_with_remainder(_shared(excess_stock(flags), flags), excess_order(), params.head_rows)


def _shared(rows: DataFrame, source: DataFrame) -> DataFrame:
    """``rows`` materialised for two readers, unless its ``source`` is cached already."""
    cached = source.storageLevel.useMemory or source.storageLevel.useDisk
    return rows if cached else reliable(rows)


def stock_risk_counts(flags: DataFrame) -> DataFrame:
    """Number of low-stock and excess-stock items in one pass."""
    return flags.agg(F.count_if(F.col("low_stock")).alias("low_stock_items"),
                     F.count_if(F.col("excess_stock")).alias("excess_stock_items"))

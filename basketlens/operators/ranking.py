"""Reusable ranking/share operators (K1-K5, A17/A19 shares, A20 folding).

All windows here run on already-aggregated frames. Top-k uses
``row_number() <= k`` so Spark inserts a WindowGroupLimit: each partition
keeps at most k rows per group before the shuffle, which also defuses hot
groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.columns import pct


def top_n_per_group(df: DataFrame, group_cols: list[str], order_cols: list[Column], n: int,
                    rank_col: str = "rank") -> DataFrame:
    """Top ``n`` rows per group by ``order_cols`` (ties broken by the later order columns)."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= n)


def value_shares(df: DataFrame, key: str, share_col: str = "share", count_col: str = "n") -> DataFrame:
    """``value_counts(normalize=True) * 100``: share of rows per non-null key.

    Counting is a map-side-combined group-by; the denominator is a window
    sum over the grouped frame (one row per key), so the input is read once.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(count_col))
    total = F.sum(count_col).over(Window.partitionBy())
    return counts.withColumn(share_col, pct(F.col(count_col), total))


def fold_small_shares(shares: DataFrame, key: str, threshold: float = 1.0, label: str = "Egyéb",
                      share_col: str = "share", count_col: str = "n") -> DataFrame:
    """Keys with share < threshold collapse into one ``label`` row.

    The folded row exists only when something folds; its share is computed
    from the summed counts (exact) rather than by adding rounded shares. A
    major key equal to ``label`` is replaced by the folded row, as the
    reference's dictionary assignment does. One pass over the shares frame.
    """
    whole = Window.partitionBy()
    small = F.col(share_col) < F.lit(threshold)
    s = shares.withColumns({"_total": F.sum(count_col).over(whole),
                            "_minor": F.max(small.cast("int")).over(whole)})
    s = s.filter(small | (F.col(key) != F.lit(label)) | (F.col("_minor") == 0))
    folded = F.when(small, F.lit(label)).otherwise(F.col(key))
    out = s.groupBy(folded.alias(key)).agg(F.sum(count_col).alias(count_col), F.max("_total").alias("_total"))
    return out.select(key, count_col, pct(F.col(count_col), F.col("_total")).alias(share_col))


def head_with_remainder(df: DataFrame, order_cols: list[Column], n: int = 10,
                        rank_col: str = "rank", rest_col: str = "more") -> DataFrame:
    """K5: the first ``n`` rows in order plus how many rows follow them.

    ``orderBy().limit(n)`` is a distributed top-k (each partition keeps n);
    the remainder comes from a count scalar subquery, not a collect.
    """
    head = df.orderBy(*order_cols).limit(n)
    total = df.select(F.count(F.lit(1))).scalar()
    w = Window.orderBy(*order_cols)   # over at most n rows
    return (head.withColumn(rank_col, F.row_number().over(w))
            .withColumn(rest_col, F.greatest(total - F.lit(n), F.lit(0)).cast("long")))


__all__ = ["fold_small_shares", "head_with_remainder", "top_n_per_group", "value_shares"]

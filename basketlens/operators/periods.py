"""Period filters: last N years present (F2), trailing window (F3), from a year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.columns import timestamp_literal


def latest_years(df: DataFrame, n: int = 2, year_col: str = "year") -> DataFrame:
    """The ``n`` largest distinct non-null years (at most ``n`` rows)."""
    return (df.select(F.col(year_col).alias("year")).dropna().distinct()
            .orderBy(F.desc("year")).limit(n))


def in_latest_years(df: DataFrame, n: int = 2, source: DataFrame | None = None) -> DataFrame:
    """rows whose year is one of the last ``n`` years present in ``source`` (default: ``df`` itself).

    The years are found first, from a read of the columns that the year
    depends on (one job that returns at most ``n`` values). They then filter
    as literals: on ``year``, which selects the partitions of a table stored
    by year, and on ``order_date``, whose range reaches the Parquet filters.
    """
    years = sorted(r["year"] for r in latest_years(source if source is not None else df, n).collect())
    cond = F.col("year").isin(years)
    if years and "order_date" in df.columns:
        cond = cond & (F.col("order_date") >= F.lit(f"{years[0]}-01-01 00:00:00").cast("timestamp_ntz"))
    return df.filter(cond)


def trailing_days(df: DataFrame, as_of, days: int = 365, ts_col: str = "order_date") -> DataFrame:
    """rows at or after ``as_of - days``; pushed to the scan as a range filter.

    On cleaned lines, whose ``year`` is the year of ``order_date``, the implied
    ``year >= year(start)`` is added too: it changes no result and lets a
    year-partitioned table skip whole partitions.
    """
    start = timestamp_literal(as_of) - F.make_dt_interval(F.lit(days))
    cond = F.col(ts_col) >= start
    if ts_col == "order_date" and "year" in df.columns:
        cond = cond & (F.col("year") >= F.year(start))
    return df.filter(cond)


def from_year(df: DataFrame, min_year: int, year_col: str = "year") -> DataFrame:
    """rows with year >= ``min_year``."""
    return df.filter(F.col(year_col) >= F.lit(min_year))

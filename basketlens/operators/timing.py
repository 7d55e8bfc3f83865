"""Purchase timing (R8): revenue by weekday and by hour over the last years.

Both read the lines of the last years only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.columns import as_double, sum0, weekday_name, weekday_no
from basketlens.operators.periods import in_latest_years
from basketlens.schema import Params


def weekday_revenue(lines: DataFrame, params: Params = Params()) -> DataFrame:
    """P9 + A15 + K7: Σ line revenue per (year, weekday); ``weekday_no`` 1 = Monday sorts it."""
    dated = in_latest_years(lines, params.recent_years).filter(F.col("order_date").isNotNull())
    return (dated.groupBy("year", weekday_no("order_date").alias("weekday_no"),
                          weekday_name("order_date").alias("weekday"))
            .agg(as_double(sum0("line_revenue")).alias("revenue")))


def hourly_revenue(lines: DataFrame, params: Params = Params()) -> DataFrame:
    """P9 + A16: Σ line revenue per (year, hour of day)."""
    dated = in_latest_years(lines, params.recent_years).filter(F.col("order_date").isNotNull())
    return (dated.groupBy("year", F.hour("order_date").alias("hour"))
            .agg(as_double(sum0("line_revenue")).alias("revenue")))

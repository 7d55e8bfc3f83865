"""Item sales from daily partials (F3, A12, R6 at any clock without the lines).

``item_days`` reduces the order lines once to a row per item and day; it can be
stored (``stage_item_days``) and new days appended. ``item_sales`` then gives
the trailing-window sales of ``inventory.item_sales`` for any clock by adding
up the days inside the window. A window that begins within a day takes that
one day from the lines, whose date range reaches their scan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.columns import sum0
from basketlens.schema import LINE_ORDINAL, Params


def item_days(lines: DataFrame) -> DataFrame:
    """item_id, item_name, day, year: quantity sold, and the stock level of the day's first line that has one (with its ordinal).

    Lines without a date, an item id or an item name take no part, as in the trailing report.
    """
    if LINE_ORDINAL not in lines.columns:
        raise ValueError(f"'first in line order' needs the line ordinal {LINE_ORDINAL!r}")
    stocked = F.when(F.col("stock_quantity").isNotNull(), F.col(LINE_ORDINAL))
    dated = lines.filter(F.col("order_date").isNotNull() & F.col("item_id").isNotNull() & F.col("item_name").isNotNull())
    return (dated.groupBy("item_id", "item_name", F.to_date("order_date").alias("day"))
            .agg(F.sum("quantity").alias("quantity"), F.min_by("stock_quantity", stocked).alias("stock_quantity"), F.min(stocked).alias("stock_line"))
            .withColumn("year", F.year("day")))


def stage_item_days(days: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store the partials by year, so that a window reads the files of its years only."""
    days.write.mode(mode).partitionBy("year").parquet(path)


def read_item_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def item_sales(days: DataFrame, params: Params, lines: DataFrame | None = None) -> DataFrame:
    """``inventory.item_sales`` at the clock ``params.as_of`` (required) from the partials.

    ``lines`` is needed only if the window does not begin at midnight; of them the first day alone is read. Partials of
    one day may come in several rows (a day appended in parts).
    """
    if params.as_of is None:
        raise ValueError("daily partials need a stated clock: params.as_of")
    clock = params.as_of if isinstance(params.as_of, dt.datetime) else dt.datetime.fromisoformat(str(params.as_of))
    start = clock - dt.timedelta(days=params.trailing_days)
    whole = start.date() if start.time() == dt.time() else start.date() + dt.timedelta(days=1)
    rows = days.filter((F.col("day") >= F.lit(whole)) & (F.col("year") >= F.lit(whole.year)))
    if start.time() != dt.time():
        if lines is None:
            raise ValueError(f"the window begins within a day ({start}): its lines are needed")
        first = lines.filter((F.col("order_date") >= F.lit(start).cast("timestamp_ntz")) & (F.col("order_date") < F.lit(dt.datetime.combine(whole, dt.time())).cast("timestamp_ntz")))
        rows = rows.unionByName(item_days(first))
    per = rows.groupBy("item_id", "item_name").agg(sum0("quantity").cast("double").alias("quantity"), F.min_by("stock_quantity", "stock_line").alias("stock_quantity"))
    return per.withColumn("daily_avg", F.col("quantity") / F.lit(float(params.trailing_days)))

"""Revenue reports: monthly/yearly net revenue (R1), average order value (R4),
category shares (R2) and top products (R3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.functions.columns import first_non_null, format_amount, last_category, pct, sum0
from basketlens.functions.materialise import reliable
from basketlens.operators.periods import in_latest_years
from basketlens.operators.ranking import top_n_per_group
from basketlens.schema import Params


def monthly_orders(orders: DataFrame) -> DataFrame:
    """Σ net revenue and number of orders per (year, month), for A2 and A5; undated orders drop out."""
    return (orders.filter(F.col("year").isNotNull() & F.col("month").isNotNull())
            .groupBy("year", "month").agg(sum0("net_revenue").alias("net_revenue"), F.count("net_revenue").alias("orders")))


def monthly_revenue(orders: DataFrame) -> DataFrame:
    """A2: Σ net revenue per (year, month)."""
    return monthly_orders(orders).select("year", "month", "net_revenue")


def average_of(monthly: DataFrame) -> DataFrame:
    """A5 from ``monthly_orders``."""
    return monthly.select("year", "month", F.try_divide(F.col("net_revenue").cast("double"), F.col("orders")).alias("avg_order_value"))


def yearly_totals(monthly: DataFrame, value: str = "net_revenue") -> DataFrame:
    """A4: Σ of the monthly values per year (a re-aggregation of A2's small output)."""
    return monthly.groupBy("year").agg(sum0(value).alias(value))


def years_of(df: DataFrame, year_col: str = "year") -> list[int]:
    """Distinct years, sorted: the pivot's column list (one tiny job, ≤ #years rows)."""
    return sorted(r[0] for r in df.select(year_col).dropna().distinct().collect())


def pivot_years(df: DataFrame, value: str, years: list[int] | None = None, index: str = "month") -> DataFrame:
    """A3/A5: ``index`` x year matrix; absent cells are null. Columns are named by year.

    (index, year) is unique in the input, so ``max`` just places the one value.
    Without ``years`` the (small, aggregated) input is materialised first, so
    the year list and the pivot read it instead of recomputing it.
    """
    if years is None:
        df = reliable(df)
        years = years_of(df)
    return df.groupBy(index).pivot("year", years).agg(F.max(value))


def revenue_matrix(monthly: DataFrame, years: list[int] | None = None) -> DataFrame:
    return pivot_years(monthly, "net_revenue", years)


def formatted(df: DataFrame, value_cols: list[str], suffix: str = "") -> DataFrame:
    """``f"{x:,.2f}"`` (+ suffix) text for each value column; null -> ''."""
    return df.withColumns({c: format_amount(c, suffix) for c in value_cols})


def revenue_formatted(monthly: DataFrame) -> DataFrame:
    return monthly.select("year", "month", format_amount("net_revenue").alias("net_revenue"))


def yearly_totals_text(totals: DataFrame) -> DataFrame:
    """P12 of A4: the yearly totals as text with two decimals."""
    return formatted(totals, ["net_revenue"])


def average_order_value(orders: DataFrame) -> DataFrame:
    """A5: mean net revenue per order for each (year, month): the exact sum, divided in double precision."""
    return average_of(monthly_orders(orders))


def aov_matrix(aov: DataFrame, years: list[int] | None = None) -> DataFrame:
    return pivot_years(aov, "avg_order_value", years)


def category_revenue(lines: DataFrame, params: Params = Params()) -> DataFrame:
    """P8 + A6 on the last ``recent_years`` years: Σ line revenue per (year, last category)."""
    recent = in_latest_years(lines, params.recent_years)
    return (recent.select("year", last_category("category_path").alias("last_category"), "line_revenue")
            .filter(F.col("last_category").isNotNull())
            .groupBy("year", "last_category").agg(sum0("line_revenue").alias("revenue")))


def category_shares(lines: DataFrame, params: Params = Params()) -> DataFrame:
    """R2: top categories per year with their share, plus the 'everything else' row.

    A single linear plan over the (year, category) frame: window totals and
    ranks per year; rows past the top k are relabelled as the rest row, and
    each year's first row is doubled into a zero rest seed, so the rest row
    exists even when a year has k categories or fewer. Shares use double
    arithmetic, then half-even rounding (revenue to whole units, share to 0.1).
    """
    k = params.top_categories
    cat = category_revenue(lines, params)
    w = Window.partitionBy("year")
    ranked = cat.withColumns({
        "total": F.sum("revenue").over(w),
        "n_cat": F.count(F.lit(1)).over(w),
        "rank": F.row_number().over(w.orderBy(F.desc("revenue"), F.asc("last_category"))),
    })
    copies = F.when(F.col("rank") == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = ranked.withColumn("_copy", F.explode(copies))
    top = (F.col("_copy") == 0) & (F.col("rank") <= k)
    label = F.when(top, F.col("last_category")).otherwise(F.lit(params.rest_label))
    out_rank = F.when(top, F.col("rank")).otherwise(F.least(F.col("n_cat"), F.lit(k)) + 1)
    value = F.when(F.col("_copy") == 1, F.lit(0)).otherwise(F.col("revenue"))
    full = (rows.groupBy("year", label.alias("last_category"), out_rank.cast("int").alias("rank"))
            .agg(F.sum(value).alias("revenue"), F.max("total").alias("total")))
    return full.select(
        "year", "rank", "last_category",
        F.bround("revenue", 0).cast("long").alias("revenue"),
        F.bround(pct("revenue", "total"), 1).alias("percentage"),
    )


def recent_order_years(lines: DataFrame, params: Params) -> DataFrame:
    """Lines of the last years present among orders (lines with an order number)."""
    return in_latest_years(lines, params.recent_years, source=lines.filter(F.col("order_number").isNotNull()))


def product_revenue(lines: DataFrame, params: Params = Params()) -> DataFrame:
    """A8 + P11: Σ line revenue and first item name per (year, item), rounded half-even."""
    recent = recent_order_years(lines, params)
    agg = (recent.filter(F.col("item_id").isNotNull() & F.col("year").isNotNull())
           .groupBy("year", "item_id")
           .agg(sum0("line_revenue").alias("revenue"), first_non_null("item_name", recent).alias("item_name")))
    return agg.withColumn("revenue", F.bround("revenue", 0).cast("long"))


def top_products(lines: DataFrame, params: Params = Params()) -> DataFrame:
    """Top products per year ranked on the rounded revenue; ties -> smaller item id."""
    return top_of_products(product_revenue(lines, params), params)


def top_of_products(products: DataFrame, params: Params = Params()) -> DataFrame:
    """K3 on revenue per (year, item)."""
    top = top_n_per_group(products, ["year"], [F.desc("revenue"), F.asc("item_id")], params.top_products)
    return top.select("year", "rank", "item_id", "item_name", "revenue")

"""One scan for many reports: sums of the order lines at several grains.

``grains`` reads the cleaned lines once and aggregates them by GROUPING SETS:
by order, by (year, item, item name), by (year, category), by (year, city) and
by customer. Partial sums are combined before the shuffle, so a grain's rows
are as many as its keys, not as the lines. The slices below give the frames
that the reports start from; "first in line order" is carried as the smallest
line ordinal next to its value, so it can be combined again at a coarser grain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.columns import first_non_null, last_category, sum0, timestamp_literal
from basketlens.operators import region, segments
from basketlens.schema import LINE_ORDINAL, Params

ORDER, ITEM, CATEGORY, CITY, CUSTOMER = "order", "item", "category", "city", "customer"


def grains(lines: DataFrame, params: Params = Params(), kinds: tuple[str, ...] = (ORDER, ITEM, CATEGORY, CITY, CUSTOMER)) -> DataFrame:
    """Sums at the wanted grains; the column ``grain`` names a row's grain. Lazy; persist it when several slices are read.

    Only the columns that the wanted grains need must be there. Null keys stay
    rows of their grain (slices drop them), told apart from the keys that a
    grain does not have by ``grouping_id``.
    """
    if LINE_ORDINAL not in lines.columns:
        raise ValueError(f"'first in line order' needs the line ordinal {LINE_ORDINAL!r}")
    line = F.col(LINE_ORDINAL)
    recent = F.coalesce(F.col("order_date") >= timestamp_literal(params.as_of) - F.make_dt_interval(F.lit(params.trailing_days)), F.lit(False))
    rows, aggs, sets = lines, [F.sum("line_revenue").alias("revenue"), F.count("order_number").alias("ordered")], {}
    if CATEGORY in kinds:
        rows = rows.withColumn("last_category", last_category("category_path"))
        sets[CATEGORY] = ["year", "last_category"]
    if ORDER in kinds:
        sets[ORDER] = ["order_number"]
        aggs += [first_non_null("refund_amount", lines).alias("refund_amount"), first_non_null("order_date", lines).alias("order_date")]
    if ITEM in kinds:
        sets[ITEM] = ["year", "item_id", "item_name"]
        aggs += [F.min(line).alias("first_line"), F.count_if(recent).alias("recent_lines")]
        if {"quantity", "stock_quantity"} <= set(lines.columns):          # for item_sales
            stocked = F.when(recent & F.col("stock_quantity").isNotNull(), line)
            aggs += [F.sum(F.when(recent, F.col("quantity"))).alias("quantity"), F.min_by("stock_quantity", stocked).alias("stock_quantity"), F.min(stocked).alias("stock_line")]
    if CITY in kinds:
        sets[CITY] = ["year", "city"]
    if CUSTOMER in kinds:
        sets[CUSTOMER] = ["email"]
        total = F.max if params.dedupe_customer_totals else F.sum
        aggs += [total(c).alias(c) for c in ("customer_total_orders", "customer_total_spent")]
        aggs += [F.min("customer_first_order").alias("customer_first_order"), F.max("customer_last_order").alias("customer_last_order")]
    keys = list(dict.fromkeys(k for cols in sets.values() for k in cols))
    # grouping_id has a bit for every key, first key highest, set where the grain lacks the key
    number = {kind: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in cols) for kind, cols in sets.items()}
    name = F.lit(None).cast("string")
    for kind, n in number.items():
        name = F.when(F.col("gid") == n, F.lit(kind)).otherwise(name)
    # keys are grouped under names of their own, so that an aggregate of a key column (order_number) reads the lines' values
    rows = rows.select("*", *[F.col(k).alias(f"_{k}") for k in keys])
    out = rows.groupingSets([[F.col(f"_{k}") for k in cols] for cols in sets.values()], *[F.col(f"_{k}") for k in keys]).agg(F.grouping_id().alias("gid"), *aggs)
    return out.withColumn("grain", name).drop("gid")


def _slice(g: DataFrame, kind: str, *keys: str) -> DataFrame:
    rows = g.filter(F.col("grain") == kind)
    for k in keys:
        rows = rows.filter(F.col(f"_{k}").isNotNull())
    return rows


def latest_years(g: DataFrame, kind: str, n: int, with_orders: bool) -> list[int]:
    """the last ``n`` years among the lines (or those that hold an order number)."""
    rows = _slice(g, kind, "year")
    if with_orders:
        rows = rows.filter("ordered > 0")
    return [r[0] for r in rows.select("_year").distinct().orderBy(F.desc("_year")).limit(n).collect()]       # at most n rows


def orders(g: DataFrame) -> DataFrame:
    """A1 + P7, as ``clean.order_totals``."""
    rows = _slice(g, ORDER, "order_number")
    revenue = F.coalesce("revenue", F.lit(0))
    return rows.select(F.col("_order_number").alias("order_number"), "order_date", F.year("order_date").alias("year"), F.month("order_date").alias("month"),
                       revenue.alias("line_revenue"), "refund_amount", (revenue - F.col("refund_amount")).alias("net_revenue"))


def category_revenue(g: DataFrame, params: Params = Params()) -> DataFrame:
    """A6 of the last years, as ``revenue.category_revenue``."""
    rows = _slice(g, CATEGORY, "last_category").filter(F.col("_year").isin(latest_years(g, CATEGORY, params.recent_years, False)))
    return rows.select(F.col("_year").alias("year"), F.col("_last_category").alias("last_category"), F.coalesce("revenue", F.lit(0)).alias("revenue"))


def product_revenue(g: DataFrame, params: Params = Params()) -> DataFrame:
    """A8 + P11, as ``revenue.product_revenue``."""
    rows = _slice(g, ITEM, "item_id").filter(F.col("_year").isin(latest_years(g, ITEM, params.recent_years, True)))
    name = F.min_by("_item_name", F.when(F.col("_item_name").isNotNull(), F.col("first_line")))
    per = rows.groupBy(F.col("_year").alias("year"), F.col("_item_id").alias("item_id")).agg(sum0("revenue").alias("revenue"), name.alias("item_name"))
    return per.withColumn("revenue", F.bround("revenue", 0).cast("long"))


def item_sales(g: DataFrame, params: Params = Params()) -> DataFrame:
    """F3 + A12 + P10, as ``inventory.item_sales``."""
    rows = _slice(g, ITEM, "item_id", "item_name").filter("recent_lines > 0")
    per = rows.groupBy(F.col("_item_id").alias("item_id"), F.col("_item_name").alias("item_name")).agg(
        sum0("quantity").cast("double").alias("quantity"), F.min_by("stock_quantity", "stock_line").alias("stock_quantity"))
    return per.withColumn("daily_avg", F.col("quantity") / F.lit(float(params.trailing_days)))


def regional_revenue(g: DataFrame, cities: DataFrame, params: Params = Params()) -> DataFrame:
    """J1 + A9, as ``region.regional_revenue``."""
    rows = _slice(g, CITY, "city").filter(F.col("_year").isin(latest_years(g, CITY, params.recent_years, True)))
    return region.located(rows.select(F.col("_year").alias("year"), F.col("_city").alias("city"), F.coalesce("revenue", F.lit(0)).alias("revenue")), cities)


def customer_features(g: DataFrame, params: Params = Params(), variant: str = "active") -> DataFrame:
    """A21/A22, as ``segments.customer_features``."""
    rows = _slice(g, CUSTOMER, "email")
    spent = F.col("revenue") if variant == "active" else F.col("customer_total_spent")
    zero = lambda c: c if params.dedupe_customer_totals else F.coalesce(c, F.lit(0))
    per = rows.select(F.col("_email").alias("email"), zero(F.col("customer_total_orders")).cast("long").alias("total_orders"),
                      (F.coalesce(spent, F.lit(0)) if variant == "active" else zero(spent)).cast("double").alias("total_spent"),
                      F.col("customer_first_order").alias("first_order"), F.col("customer_last_order").alias("last_order"))
    return segments.with_recency(per, params, variant)

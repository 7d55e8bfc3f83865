"""The report bundle, every summary table over the cleaned order lines.

The lines are read once: ``grains`` aggregates them at all the grains that the
tables start from, and every table reads its slice of that frame. It is
persisted and freed by ``release``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions.materialise import reliable
from basketlens.operators import inventory, region, revenue, segments
from basketlens.operators.ranking import top_n_per_group
from basketlens.plans import grains
from basketlens.schema import Params


def _top_categories(categories: DataFrame, params: Params) -> DataFrame:
    top = top_n_per_group(categories, ["year"], [F.desc("revenue"), F.asc("last_category")], params.top_categories)
    return top.select("year", "rank", "last_category", "revenue")


def _held(g: DataFrame) -> DataFrame:
    return g.persist(StorageLevel.MEMORY_AND_DISK)


def bundle_top_categories(lines: DataFrame, params: Params = Params()) -> DataFrame:
    """The top categories of each year with their exact revenue (no share, no rest row)."""
    return _top_categories(grains.category_revenue(reliable(grains.grains(lines, params, (grains.CATEGORY,))), params), params)


def bundle_top_products(lines: DataFrame, params: Params = Params()) -> DataFrame:
    """The top products of each year: item name and rounded revenue."""
    g = reliable(grains.grains(lines, params, (grains.ITEM,)))
    return revenue.top_of_products(grains.product_revenue(g, params), params).select("year", "rank", "item_name", "revenue")


def report_bundle(lines: DataFrame, cities: DataFrame, params: Params = Params(),
                  with_segments: bool = True) -> dict[str, DataFrame]:
    """Monthly matrix, AOV matrix, top products, top categories, county totals,
    stock-risk counts and (optionally) the cluster summary, as DataFrames."""
    kinds = (grains.ORDER, grains.ITEM, grains.CATEGORY, grains.CITY, *((grains.CUSTOMER,) if with_segments else ()))
    g = _held(grains.grains(lines, params, kinds))
    months = _held(revenue.monthly_orders(grains.orders(g)))
    monthly, aov = months.select("year", "month", "net_revenue"), revenue.average_of(months)
    years = revenue.years_of(months)
    matrix = revenue.revenue_matrix(monthly, years)
    held = [g, months]
    out = {
        "revenue_matrix": matrix,
        "revenue_matrix_text": revenue.formatted(matrix, [str(y) for y in years]),
        "yearly_totals": revenue.yearly_totals(monthly),
        "aov_matrix": revenue.aov_matrix(aov, years),
        "top_products": revenue.top_of_products(grains.product_revenue(g, params), params).select("year", "rank", "item_name", "revenue"),
        "top_categories": _top_categories(grains.category_revenue(g, params), params),
        "county_totals": region.county_totals(grains.regional_revenue(g, cities, params)),
        "stock_risk_counts": inventory.stock_risk_counts(inventory.stock_flags(grains.item_sales(g, params), params)),
    }
    if with_segments:
        seg = segments.segment(grains.customer_features(g, params, "all"), segments.ALL_FEATURES, params)
        out["cluster_summary"] = seg.summary
        held += seg.cached
    out["_persisted"] = held
    return out


def release(bundle: dict) -> None:
    for df in bundle.get("_persisted", []):
        df.unpersist()

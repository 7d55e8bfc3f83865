"""Report-level plans (R1-R14): each report computes its shared aggregate once.

A report has several outputs (long table, matrix, totals, heads, counts).
The aggregate they share is persisted (memory and disk; recomputed from
lineage if an executor is lost) so the order lines are read once per
report; ``Report.release`` unpersists it. The persisted frames are
aggregates (months, items, cities, per-order rows), never raw lines.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.columns import as_double, pct
from basketlens.operators import (
    audience, clean, discounts, inventory, privacy, region, revenue, segments, timing,
)
from basketlens.operators.ranking import fold_small_shares
from basketlens.plans import catalog as C
from basketlens.schema import Params
from basketlens.sources import tables

MEM_DISK = StorageLevel.MEMORY_AND_DISK


def small_sorted(df: DataFrame, *order) -> DataFrame:
    """Display order for a bounded output (top-k, per year/month rows): one
    partition sorted locally, with no range-partitioning sample job."""
    return df.coalesce(1).sortWithinPartitions(*order)


@dataclass
class Report:
    outputs: dict[str, DataFrame]
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()


def monthly_report(lines: DataFrame) -> Report:
    """Monthly net revenue (long, matrix, formatted), yearly totals."""
    monthly = revenue.monthly_revenue(clean.order_totals(lines)).persist(MEM_DISK)
    years = revenue.years_of(monthly)          # first action: fills the cache
    matrix = revenue.revenue_matrix(monthly, years)
    return Report({
        "monthly_revenue": small_sorted(C.finalize(monthly), "year", "month"),
        "revenue_matrix": small_sorted(C.finalize(matrix), "month"),
        "revenue_matrix_text": small_sorted(revenue.formatted(matrix, [str(y) for y in years]), "month"),
        "yearly_totals": small_sorted(C.finalize(revenue.yearly_totals(monthly)), "year"),
    }, [monthly])


def aov_report(lines: DataFrame) -> Report:
    """Average order value per month, long and as a matrix."""
    aov = revenue.average_order_value(clean.order_totals(lines)).persist(MEM_DISK)
    years = revenue.years_of(aov)
    return Report({"average_order_value": small_sorted(aov, "year", "month"),
                   "aov_matrix": small_sorted(revenue.aov_matrix(aov, years), "month"),
                   "aov_matrix_text": small_sorted(revenue.formatted(revenue.aov_matrix(aov, years),
                                                                     [str(y) for y in years], " Ft"), "month")},
                  [aov])


def region_report(lines: DataFrame, cities: DataFrame, params: Params) -> Report:
    """Regional revenue, top counties and cities per year, county totals."""
    regional = region.regional_revenue(lines, cities, params).persist(MEM_DISK)
    return Report({"regional_revenue": C.finalize(regional),
                   "top_counties": small_sorted(region.top_counties(regional, params), F.desc("year"), "rank"),
                   "top_cities": small_sorted(region.top_cities(regional, params), F.desc("year"), "rank"),
                   "county_totals": small_sorted(region.county_totals(regional), F.desc("revenue"), "county")},
                  [regional])


def stock_report(lines: DataFrame, params: Params) -> Report:
    """Item sales of the trailing year (persisted), thresholds, risk lists, heads, counts."""
    items = inventory.item_sales(lines, params).persist(MEM_DISK)
    flags = inventory.stock_flags(items, params).persist(MEM_DISK)
    return Report({"stock_thresholds": inventory.stock_thresholds(items, params),
                   "low_stock": inventory.low_stock(flags).orderBy(*inventory.low_order()),
                   "excess_stock": inventory.excess_stock(flags).orderBy(*inventory.excess_order()),
                   "low_stock_head": small_sorted(inventory.low_stock_head(flags, params), "rank"),
                   "excess_stock_head": small_sorted(inventory.excess_stock_head(flags, params), "rank"),
                   "stock_risk_counts": inventory.stock_risk_counts(flags)}, [flags, items])


def gender_report(lines: DataFrame) -> Report:
    """Line share per gender and orders/revenue per gender from one per-order aggregate."""
    per_order = (lines.filter(F.col("gender").isNotNull())
                 .groupBy("gender", "order_number")
                 .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("line_revenue").alias("revenue"))
                 .persist(MEM_DISK))
    per_gender = per_order.groupBy("gender").agg(
        F.sum("n_lines").alias("n"), F.count("order_number").alias("orders"),
        as_double(F.coalesce(F.sum("revenue"), F.lit(0))).alias("revenue"))
    from pyspark.sql import Window
    share = per_gender.select("gender", "n", pct(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("share"))
    return Report({"gender_share": small_sorted(share, F.desc("share"), "gender"),
                   "gender_summary": small_sorted(per_gender.select("gender", "orders", "revenue"), "gender")},
                  [per_order])


def origin_report(lines: DataFrame, params: Params) -> Report:
    """Origin shares since ``origin_min_year`` and the folded view."""
    shares = audience.origin_share(lines, params).persist(MEM_DISK)
    folded = fold_small_shares(shares, "origin", params.share_threshold, params.other_label)
    return Report({"origin_share": small_sorted(shares, F.desc("share"), "origin"),
                   "origin_folded": small_sorted(folded, F.desc("share"), "origin")}, [shares])


def segment_report(lines: DataFrame, params: Params, variant: str) -> Report:
    """Features, k-means segments, summary with names, assignment table."""
    cols = segments.ACTIVE_FEATURES if variant == "active" else segments.ALL_FEATURES
    seg = segments.segment(segments.customer_features(lines, params, variant), cols, params)
    return Report({"cluster_summary": small_sorted(seg.summary, "cluster"),
                   "assignments": segments.assignments_view(seg.assignments),
                   "left_out": seg.coverage},
                  seg.cached)


# --- the reports over the bound test tables (used by bench.py) -------------

def _bound(spark: SparkSession, d: str) -> dict[str, Callable[[], Report]]:
    P = C.P
    return {
        "R1_monthly_revenue": lambda: monthly_report(C.lines(spark, d)),
        "R2_category_shares": lambda: Report({"category_shares": small_sorted(revenue.category_shares(
            C.lines(spark, d, "category_path"), P), F.desc("year"), "rank")}),
        "R3_top_products": lambda: Report({"top_products": small_sorted(revenue.top_products(
            C.lines(spark, d, "item_id", "item_name"), P), F.desc("year"), "rank")}),
        "R4_average_order_value": lambda: aov_report(C.lines(spark, d)),
        "R5_regions": lambda: region_report(C.lines(spark, d, "city"), tables.city_county_table(spark, d), P),
        "R6_stock_risks": lambda: stock_report(
            C.lines(spark, d, "item_id", "item_name", "quantity", "stock_quantity"), P),
        "R7_discounts": lambda: Report({"discount_summary": small_sorted(
            discounts.discount_summary(C.lines(spark, d)), "year")}),
        "R8_purchase_timing": lambda: Report({
            "weekday_revenue": small_sorted(timing.weekday_revenue(C.lines(spark, d), P), "year", "weekday_no"),
            "hourly_revenue": small_sorted(timing.hourly_revenue(C.event_lines(spark, d), P), "year", "hour")}),
        "R9_gender": lambda: gender_report(C.lines(spark, d, "gender")),
        "R10_origin": lambda: origin_report(C.event_lines(spark, d),
                                            P.with_(share_threshold=C.ORIGIN_FOLD_THRESHOLD)),
        "R11_segments_active": lambda: segment_report(C.lines(spark, d, *C._FEATURE_COLS), P, "active"),
        "R12_segments_all": lambda: segment_report(C.lines(spark, d, *C._FEATURE_COLS), P, "all"),
        "R14_anonymised_lines": lambda: Report({"anonymised_lines": C.q_anonymised_lines(spark, d)}),
    }


def bound_reports(spark: SparkSession, sf_dir: str) -> dict[str, Callable[[], Report]]:
    return _bound(spark, sf_dir)





# --- user entry points over canonical order lines ---------------------------

def all_reports(lines: DataFrame, cities: DataFrame | None = None, params: Params = Params(),
                segments_too: bool = True) -> dict[str, Report]:
    """Every report of the analyser (R1-R12) over cleaned order lines (``clean.order_lines``).

    Building runs small jobs: the year lists of matrices and of the last-years
    reports, and the k-means fits. Each report persists its own shared
    aggregate when its outputs run, and ``Report.release`` frees it.
    """
    have = set(lines.columns)

    def has(*cols: str) -> bool:       # F11: a report runs only when its columns exist
        return set(cols) <= have

    out: dict[str, Report] = {
        "R1_monthly_revenue": monthly_report(lines),
        "R4_average_order_value": aov_report(lines),
        "R7_discounts": Report({"discount_summary": small_sorted(discounts.discount_summary(lines), "year")}),
        "R8_purchase_timing": Report({
            "weekday_revenue": small_sorted(timing.weekday_revenue(lines, params), "year", "weekday_no"),
            "hourly_revenue": small_sorted(timing.hourly_revenue(lines, params), "year", "hour")}),
    }
    if has("category_path"):
        out["R2_category_shares"] = Report({"category_shares": small_sorted(
            revenue.category_shares(lines, params), F.desc("year"), "rank")})
    if has("item_id", "item_name"):
        out["R3_top_products"] = Report({"top_products": small_sorted(
            revenue.top_products(lines, params), F.desc("year"), "rank")})
    if has("item_id", "item_name", "quantity", "stock_quantity"):
        out["R6_stock_risks"] = stock_report(lines, params)
    if cities is not None and has("city"):
        out["R5_regions"] = region_report(lines, cities, params)
    if has("gender"):
        out["R9_gender"] = gender_report(lines)
    if has("origin"):
        out["R10_origin"] = origin_report(lines, params)
    if segments_too and has("email", "customer_total_orders", "customer_first_order", "customer_last_order"):
        out["R11_segments_active"] = segment_report(lines, params, "active")
        if has("customer_total_spent"):
            out["R12_segments_all"] = segment_report(lines, params, "all")
    return out


def anonymise_file(spark: SparkSession, path: str, male_names: str, female_names: str,
                   params: Params = Params(), fmt: str = "parquet", out_path: str | None = None) -> str:
    """R14 end to end (S1 -> Q1 -> S4): read an export, anonymise it, write it next to
    the input as ``<stem>_anonymized`` (or to ``out_path``); returns the output path."""
    import os

    from basketlens.sources.readers import read_name_list, read_order_lines, write_table
    raw = read_order_lines(spark, path, fmt=fmt, with_ordinal=False)
    anon = privacy.anonymise(raw, read_name_list(spark, male_names), read_name_list(spark, female_names), params)
    head, name = os.path.split(path.rstrip("/"))
    target = out_path or os.path.join(head, os.path.splitext(name)[0] + "_anonymized")
    write_table(anon, target, fmt=fmt)
    return target


__all__ = ["Report", "all_reports", "anonymise_file", "aov_report", "bound_reports", "gender_report",
           "monthly_report", "origin_report", "region_report", "segment_report", "stock_report"]

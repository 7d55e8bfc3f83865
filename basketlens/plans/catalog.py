"""Named report queries over the bound test tables.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame. The
bound order lines are built column-driven (only the joins a report needs),
cleaned by ``order_lines`` and fed to the operators. Output money columns
are decimals inside the plans (exact, order-independent sums) and doubles
at the boundary.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.functions.materialise import reliable
from basketlens.functions.names import normalise_name
from basketlens.operators import (
    audience, clean, daily, discounts, inventory, privacy, region, revenue, segments, sketches, timing,
)
from basketlens.plans import bundle, grains
from basketlens.schema import LINE_ORDINAL, REQUIRED_COLUMNS
from basketlens.sources import tables
from basketlens.sources.readers import name_list
from basketlens.sources.reconcile import column_votes, reconcile

P = tables.test_params()
BASE = [*REQUIRED_COLUMNS, LINE_ORDINAL]


def finalize(df: DataFrame) -> DataFrame:
    """Cast decimal columns to double for the report boundary."""
    casts = {f.name: F.col(f.name).cast("double") for f in df.schema.fields
             if isinstance(f.dataType, T.DecimalType)}
    return df.withColumns(casts) if casts else df


def lines(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    return clean.order_lines(tables.order_line_table(spark, d, [*BASE, *extra]), P)


def orders(spark: SparkSession, d: str) -> DataFrame:
    return clean.order_totals(lines(spark, d))


def event_lines(spark: SparkSession, d: str) -> DataFrame:
    return clean.order_lines(tables.event_lines(spark, d), P)


def name_lookups(spark: SparkSession):
    male, female = tables.name_lists(spark)
    return name_list(male), name_list(female)


def q_order_lines_clean(spark, d):
    cols = [c for c in tables.LINE_COLUMNS if c not in BASE]
    df = lines(spark, d, *cols)
    return finalize(df.drop(LINE_ORDINAL))


def q_text_dates(spark, d):
    """P4 on text: the orders' dates written in two formats, whose patterns are inferred."""
    df = tables.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("order_number"), F.date_format("o_orderdate", "yyyy.MM.dd HH:mm").alias("order_date"),
                                                      F.date_format("o_orderdate", "dd/MM/yyyy").alias("day_first"))
    infer = P.with_(date_format="infer")
    return df.select("order_number", *[clean.parsed_date(df, c, infer).alias(c) for c in ("order_date", "day_first")])


def _exports(spark, d):
    """All orders as three exports by status, whose headers, types and columns differ."""
    df = tables.read_table(spark, d, "orders")
    status, price = F.coalesce("o_orderstatus", F.lit("")), F.col("o_totalprice").cast("decimal(18,2)")
    return {
        "open": df.where(status == "O").select(
            F.col("o_orderkey").cast("string").alias("order number"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("ORDER DATE"),
            F.col("o_orderstatus").alias("Order status"), F.concat(F.lit(" "), price.cast("string")).alias("Order Line Total (Include Tax)"), F.col("o_orderpriority").alias("origin")),
        "finished": df.where(status == "F").select(
            F.col("o_orderkey").alias("Order Number"), F.col("o_orderdate").alias("Order Date"), F.col("o_orderstatus").alias("Order Status"),
            price.alias("Order Line Total (include tax)")),
        "rest": df.where(~status.isin("O", "F")).select(
            price.alias("line_total"), F.col("o_orderkey").alias("order_number"), F.to_date("o_orderdate").alias("order_date"), F.col("o_orderstatus").alias("order_status")),
    }


def q_reconciled_exports(spark, d):
    """S1 over three unlike exports."""
    return finalize(reconcile(spark, _exports(spark, d))[0])


def q_export_votes(spark, d):
    """How many values of each column of each export read as which kind."""
    return column_votes(spark, _exports(spark, d)).drop("header", "declared")


def q_order_totals(spark, d):
    return finalize(orders(spark, d))


def q_monthly_revenue(spark, d):
    return finalize(revenue.monthly_revenue(orders(spark, d)))


def q_revenue_matrix(spark, d):
    return finalize(revenue.revenue_matrix(revenue.monthly_revenue(orders(spark, d))))


def q_yearly_totals(spark, d):
    return finalize(revenue.yearly_totals(revenue.monthly_revenue(orders(spark, d))))


def q_yearly_totals_text(spark, d):
    return revenue.yearly_totals_text(revenue.yearly_totals(revenue.monthly_revenue(orders(spark, d))))


def q_revenue_formatted(spark, d):
    return revenue.revenue_formatted(revenue.monthly_revenue(orders(spark, d)))


def q_revenue_matrix_text(spark, d):
    monthly = reliable(revenue.monthly_revenue(orders(spark, d)))
    years = revenue.years_of(monthly)
    return revenue.formatted(revenue.revenue_matrix(monthly, years), [str(y) for y in years])


def q_average_order_value(spark, d):
    return revenue.average_order_value(orders(spark, d))


def q_aov_matrix(spark, d):
    return revenue.aov_matrix(revenue.average_order_value(orders(spark, d)))


def q_aov_matrix_text(spark, d):
    aov = reliable(revenue.average_order_value(orders(spark, d)))
    years = revenue.years_of(aov)
    return revenue.formatted(revenue.aov_matrix(aov, years), [str(y) for y in years], " Ft")


def q_category_revenue(spark, d):
    return finalize(revenue.category_revenue(lines(spark, d, "category_path"), P))


def q_category_shares(spark, d):
    return revenue.category_shares(lines(spark, d, "category_path"), P)


def q_top_products(spark, d):
    return revenue.top_products(lines(spark, d, "item_id", "item_name"), P)


def _regional(spark, d):
    return region.regional_revenue(lines(spark, d, "city"), tables.city_county_table(spark, d), P)


def q_regional_revenue(spark, d):
    return finalize(_regional(spark, d))


def q_top_counties(spark, d):
    return region.top_counties(_regional(spark, d), P)


def q_top_cities(spark, d):
    return region.top_cities(_regional(spark, d), P)


def q_county_totals(spark, d):
    return region.county_totals(_regional(spark, d))


def _items(spark, d):
    return inventory.item_sales(lines(spark, d, "item_id", "item_name", "quantity", "stock_quantity"), P)


def _flags(spark, d):
    return inventory.stock_flags(_items(spark, d), P)


def q_item_sales(spark, d):
    return _items(spark, d)


#: Clocks at which the trailing item sales are taken from the daily partials.
CLOCKS = (dt.datetime(2001, 8, 1), dt.datetime(1999, 3, 15), dt.datetime(1996, 1, 1))


def q_item_sales_by_clock(spark, d):
    """F3 + A12 at three clocks from one frame of daily partials."""
    days = reliable(daily.item_days(lines(spark, d, "item_id", "item_name", "quantity", "stock_quantity")))
    parts = [daily.item_sales(days, P.with_(as_of=clock)).select(F.lit(clock.date().isoformat()).alias("as_of"), "*") for clock in CLOCKS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def q_stock_thresholds(spark, d):
    return inventory.stock_thresholds(_items(spark, d), P)


def q_low_stock(spark, d):
    return inventory.low_stock(_flags(spark, d))


def q_excess_stock(spark, d):
    return inventory.excess_stock(_flags(spark, d))


def q_low_stock_head(spark, d):
    return inventory.low_stock_head(_flags(spark, d), P)


def q_excess_stock_head(spark, d):
    return inventory.excess_stock_head(_flags(spark, d), P)


def q_stock_risk_counts(spark, d):
    return inventory.stock_risk_counts(_flags(spark, d))


def q_discount_summary(spark, d):
    return discounts.discount_summary(lines(spark, d))


def q_weekday_revenue(spark, d):
    return timing.weekday_revenue(lines(spark, d), P)


def q_hourly_revenue(spark, d):
    return timing.hourly_revenue(event_lines(spark, d), P)


def q_gender_share(spark, d):
    return audience.gender_share(lines(spark, d, "gender"))


def q_gender_summary(spark, d):
    return audience.gender_summary(lines(spark, d, "gender"))


def q_gender_share_text(spark, d):
    return audience.shares_text(audience.gender_share(lines(spark, d, "gender")), "gender")


def q_discount_summary_sketch(spark, d):
    """A14 from monthly sketches, beside the exact rows."""
    every = lines(spark, d, "gender")
    return sketches.against_exact(sketches.discount_summary(sketches.monthly_partials(every)), discounts.discount_summary(every), "year", "discounted_orders")


def q_gender_summary_sketch(spark, d):
    """A18 from monthly sketches, beside the exact rows."""
    every = lines(spark, d, "gender")
    return sketches.against_exact(sketches.gender_summary(sketches.monthly_partials(every)), audience.gender_summary(every), "gender", "orders")


def q_origin_share_text(spark, d):
    return audience.shares_text(audience.origin_share(event_lines(spark, d), P), "origin")


def q_origin_share(spark, d):
    return audience.origin_share(event_lines(spark, d), P)


# Every event type holds about a fifth of the events, so the default 1 %
# threshold folds nothing; 20 % makes the two smallest types fold.
ORIGIN_FOLD_THRESHOLD = 20.0


def q_origin_folded(spark, d):
    return audience.origin_folded(event_lines(spark, d), P.with_(share_threshold=ORIGIN_FOLD_THRESHOLD))


_FEATURE_COLS = ["email", "customer_total_orders", "customer_total_spent",
                 "customer_first_order", "customer_last_order"]


def _features(spark, d, variant):
    return segments.customer_features(lines(spark, d, *_FEATURE_COLS), P, variant)


def q_customer_features_active(spark, d):
    return _features(spark, d, "active")


def q_customer_features_all(spark, d):
    return _features(spark, d, "all")


def q_scaled_features(spark, d):
    cols = segments.ACTIVE_FEATURES
    scaled = segments.scale_features(_features(spark, d, "active"), cols)
    return scaled.select("email", *[F.round(F.col(c + "_z"), 6).alias(c + "_z") for c in cols])


def q_segment_rule(spark, d):
    return segments.customer_activity(lines(spark, d, "email"), P)


def _segmentation(spark, d, variant):
    cols = segments.ACTIVE_FEATURES if variant == "active" else segments.ALL_FEATURES
    return segments.segment(_features(spark, d, variant), cols, P)


def _summary(spark, d, variant):
    """A23 with means to four decimals (half-even)."""
    summary = _segmentation(spark, d, variant).summary
    cols = segments.ACTIVE_FEATURES if variant == "active" else segments.ALL_FEATURES
    return summary.withColumns({c: F.bround(c, 4) for c in cols})


def q_segment_summary_active(spark, d):
    return _summary(spark, d, "active")


def q_segment_summary_all(spark, d):
    return _summary(spark, d, "all")


def q_segment_assignments(spark, d):
    return segments.assignments_view(_segmentation(spark, d, "active").assignments)


def q_segment_check(spark, d):
    parts = []
    for variant in ("active", "all"):
        check = segments.segment_check(_segmentation(spark, d, variant))
        parts.append(check.select(F.lit(variant).alias("variant"), "*"))
    return parts[0].unionByName(parts[1])


def q_segment_rule_summary(spark, d):
    return segments.rule_summary(q_segment_rule(spark, d))


def q_bundle_top_categories(spark, d):
    return finalize(bundle.bundle_top_categories(lines(spark, d, "category_path"), P))


def q_bundle_top_products(spark, d):
    return bundle.bundle_top_products(lines(spark, d, "item_id", "item_name"), P)


#: Columns of the order lines that the report bundle reads beside the base ones.
BUNDLE_COLUMNS = ["city", "category_path", "item_id", "item_name", "quantity", "stock_quantity", *_FEATURE_COLS]


def _grains(spark, d):
    """The bundle's one frame, at all grains."""
    return reliable(grains.grains(lines(spark, d, *BUNDLE_COLUMNS), P))


def q_grain_orders(spark, d):
    """A1, A2, A4, A5 by month from the one scan."""
    months = revenue.monthly_orders(grains.orders(_grains(spark, d)))
    return finalize(months.withColumn("avg_order_value", F.try_divide(F.col("net_revenue").cast("double"), F.col("orders"))))


def q_grain_categories(spark, d):
    return finalize(grains.category_revenue(_grains(spark, d), P))


def q_grain_top_products(spark, d):
    return revenue.top_of_products(grains.product_revenue(_grains(spark, d), P), P)


def q_grain_item_sales(spark, d):
    return grains.item_sales(_grains(spark, d), P)


def q_grain_regions(spark, d):
    return finalize(grains.regional_revenue(_grains(spark, d), tables.city_county_table(spark, d), P))


def q_grain_customers(spark, d):
    """A22 from the one scan."""
    return grains.customer_features(_grains(spark, d), P, "all")


def q_masked_emails(spark, d):
    cust = tables.customer_table(spark, d)
    return privacy.mask_emails(cust.select("customer_id", "email", F.col("email").alias("masked_email")),
                               P, "masked_email")


def q_normalised_names(spark, d):
    cust = tables.customer_table(spark, d)
    return privacy.normalised_names(cust.select("customer_id", "first_name", "last_name"))


def q_normalised_words(spark, d):
    """N1 on text of the tables: every distinct word of the documents."""
    words = tables.read_table(spark, d, "documents").select(F.explode(F.split("text", r"[ \t\n\x0B\f\r]+")).alias("word"))
    return words.filter(F.col("word") != "").distinct().withColumn("word_norm", normalise_name("word"))


def q_inferred_gender(spark, d):
    male, female = name_lookups(spark)
    cust = tables.customer_table(spark, d).select("customer_id", "first_name", "last_name")
    return privacy.infer_gender(cust, privacy.name_flags(male, female))


def q_anonymised_customers(spark, d):
    male, female = name_lookups(spark)
    return privacy.anonymise(tables.customer_table(spark, d), male, female, P)


def q_split_customer_names(spark, d):
    """J2 by split hot names; the same rows as the plain join's."""
    male, female = name_lookups(spark)
    cust = tables.customer_table(spark, d).select("customer_id", "first_name", "last_name")
    return privacy.infer_gender(cust, privacy.name_flags(male, female), split_parts=8)


ANON_LINE_COLUMNS = ["order_number", LINE_ORDINAL, "order_date", "order_status", "city", "email",
                     "line_total", "refund_amount", "discount_amount", "item_id", "item_name",
                     "quantity", "category_path", "gender", "origin", *tables.NAME_COLUMNS]


def q_anonymised_lines(spark, d):
    male, female = name_lookups(spark)
    raw = tables.order_line_table(spark, d, ANON_LINE_COLUMNS)
    return finalize(privacy.anonymise(raw, male, female, P))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}

"""Order-line cleaning (P1-P7, F1) and the order roll-up (A1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.functions.columns import exact_amount, first_non_null, infer_date_format, money, sum0, to_timestamp_ntz
from basketlens.schema import KEEP_COLUMNS, LINE_ORDINAL, MONEY_COLUMNS, REQUIRED_COLUMNS, Params


def missing_columns(raw: DataFrame, keep: list[str] = KEEP_COLUMNS) -> list[str]:
    """Listed columns absent from the input (schema only, no job)."""
    present = set(raw.columns)
    return [c for c in keep if c not in present]


def missing_columns_frame(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """P2 as a one-column DataFrame, for reports."""
    return spark.createDataFrame([(c,) for c in missing_columns(raw)], "missing_column string")


def keep_known_columns(raw: DataFrame) -> DataFrame:
    """Keep the listed columns that exist (plus the line ordinal)."""
    cols = [c for c in [*KEEP_COLUMNS, LINE_ORDINAL] if c in raw.columns]
    return raw.select(*cols)


def _require(raw: DataFrame, cols: list[str]) -> None:
    absent = [c for c in cols if c not in raw.columns]
    if absent:
        raise ValueError(f"order lines lack required columns: {absent}")


def _numeric(df: DataFrame, name: str, to: str) -> F.Column:
    dtype = df.schema[name].dataType
    c = F.col(name)
    if isinstance(dtype, T.NumericType):
        return c.cast(to)
    return c.try_cast(to)


def parsed_date(df: DataFrame, name: str, params: Params) -> F.Column:
    """P4 with the stated, inferred or ISO-like format; text around which there is white space counts without it if inferred."""
    if params.date_format != "infer":
        return to_timestamp_ntz(df, name, params.date_format)
    return to_timestamp_ntz(df, name, infer_date_format(df, name), strip=True)


def order_lines(raw: DataFrame, params: Params = Params()) -> DataFrame:
    """Cleaned completed order lines with year, month and line revenue.

    P1 keep list, F1 status filter, P3 money coercion, P4 date parsing,
    P5 year/month, P6 line revenue. Lazy: no job runs here but for an inferred format. The status
    filter sits directly on the raw column, so it reaches the scan. With
    ``params.date_format = "infer"`` the pattern of each text date column is
    found first, in one pass that counts the texts each pattern parses.
    """
    _require(raw, REQUIRED_COLUMNS)
    df = keep_known_columns(raw)
    df = df.filter(F.col("order_status") == F.lit(params.completed_status))
    casts = {c: money(c) for c in MONEY_COLUMNS}
    for c in ("order_date", "customer_first_order", "customer_last_order"):
        if c in df.columns:
            casts[c] = parsed_date(df, c, params)
    for c in ("quantity", "stock_quantity"):
        if c in df.columns:
            casts[c] = _numeric(df, c, "double")
    if "customer_total_spent" in df.columns:
        casts["customer_total_spent"] = exact_amount("customer_total_spent")
    if "customer_total_orders" in df.columns:
        casts["customer_total_orders"] = _numeric(df, "customer_total_orders", "bigint")
    df = df.withColumns(casts)
    return df.withColumns({
        "year": F.year("order_date"),
        "month": F.month("order_date"),
        "line_revenue": (F.col("line_total") - F.col("discount_amount")).cast("decimal(29,6)"),
    })


def order_totals(lines: DataFrame) -> DataFrame:
    """A1 + P7: one row per order with Σ line revenue, first refund/date and net revenue.

    Grouping by order number is one shuffle with map-side partial sums.
    """
    dated = F.struct("order_date", "year", "month")
    agg = (
        lines.filter(F.col("order_number").isNotNull())
        .groupBy("order_number")
        .agg(
            sum0("line_revenue").alias("line_revenue"),
            first_non_null("refund_amount", lines).alias("refund_amount"),
            first_non_null(dated, lines, present=F.col("order_date").isNotNull()).alias("d"),
        )
    )
    return agg.select(
        "order_number",
        F.col("d.order_date").alias("order_date"),
        F.col("d.year").alias("year"),
        F.col("d.month").alias("month"),
        "line_revenue",
        "refund_amount",
        (F.col("line_revenue") - F.col("refund_amount")).alias("net_revenue"),
    )

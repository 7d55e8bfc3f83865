"""Binding of the TPC-H-like test tables to the canonical order-line schema.

The driver's tables are a star schema; an order-line export is one flat
table. This module derives that flat table lazily, joining only the tables
the requested columns need (column-driven), so a revenue report reads
``lineitem`` and ``orders`` only, and never aggregates customer totals
unless a segment report asks for them.

Stand-in columns (no natural counterpart in the test tables):
  refund_amount  5 % of the order total for '1-URGENT' orders, else 0
  city           the customer's nation name; null for nation keys divisible by 7
  city -> county nation -> region, leaving out nation keys divisible by 5
  email          customer name + '@example.com'
  category_path  'Shop > ' || p_type || ' > ' || p_brand || ' '
  stock_quantity p_size % 10
  gender         c_mktsegment;  origin: o_orderpriority
  names          fixed lists indexed by c_custkey % 10
  line_no        l_orderkey * 8 + l_linenumber: the export is taken to list lines
                 by order and line number (l_linenumber <= 7), so "first" means
                 the lowest line of an order; SQL oracles can rebuild it from
                 the registered views, which a physical row index would not allow
"""

from __future__ import annotations

import datetime as dt
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.schema import LINE_ORDINAL, Params

COMPLETED = "F"
AS_OF = dt.datetime(2001, 8, 1)


def test_params(**kw) -> Params:
    """Parameters matching the bound test tables (status 'F', fixed clock)."""
    return Params(completed_status=COMPLETED, as_of=AS_OF).with_(**kw)


# --- fixed values: stand-in personal data for the privacy binding ----------
FIRST_NAMES = ["Győző", " ANNA ", "Xqz", "Xqz", None, None, "Zoltán", "Ágnes", "\tÉva ", "Kim"]
LAST_NAMES = ["Nagy", "Péter", "Péter", "Kovácsné", "Xqz", None, "Szabó", "Tóth", None, "Straße"]
MALE_NAMES = ["Győző", "Péter", "Zoltán", "István", "Kim"]
FEMALE_NAMES = ["anna", " Ágnes ", "ÉVA", "Mária", "Kim", ""]

_LINEITEM = {
    "order_number": "l_orderkey",
    "item_id": "l_partkey",
    "quantity": "l_quantity",
}

_NEEDS = {
    "order_date": {"orders"}, "order_status": {"orders"}, "refund_amount": {"orders"},
    "origin": {"orders"},
    "email": {"orders", "customer"}, "gender": {"orders", "customer"},
    "first_name": {"orders", "customer"}, "last_name": {"orders", "customer"},
    "first_name_shipping": {"orders", "customer"}, "last_name_shipping": {"orders", "customer"},
    "phone_billing": {"orders", "customer"}, "address_billing": {"orders", "customer"},
    "postcode_billing": {"orders", "customer"}, "country_code_billing": {"orders", "customer"},
    "city": {"orders", "customer", "nation"},
    "item_name": {"part"}, "category_path": {"part"}, "stock_quantity": {"part"},
    "customer_total_orders": {"orders", "totals"}, "customer_total_spent": {"orders", "totals"},
    "customer_first_order": {"orders", "totals"}, "customer_last_order": {"orders", "totals"},
}

LINE_COLUMNS = [
    "order_number", LINE_ORDINAL, "order_date", "order_status", "city", "email",
    "line_total", "refund_amount", "discount_amount",
    "customer_total_spent", "customer_total_orders", "customer_first_order", "customer_last_order",
    "item_id", "item_name", "quantity", "stock_quantity", "category_path", "gender", "origin",
]
NAME_COLUMNS = ["first_name", "last_name", "first_name_shipping", "last_name_shipping",
                "phone_billing", "address_billing", "postcode_billing", "country_code_billing"]


_READ_CACHE: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name``; the DataFrame (listing + footers) is reused per session."""
    per_session = _READ_CACHE.setdefault(spark, {})
    df = per_session.get((sf_dir, name))
    if df is None:
        df = per_session[(sf_dir, name)] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df


def _pick(values: list, key) -> F.Column:
    """Element ``key % len(values)`` of a fixed list (nulls allowed)."""
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def customer_names(cust: DataFrame) -> dict[str, F.Column]:
    key = F.col("c_custkey")
    return {
        "first_name": _pick(FIRST_NAMES, key),
        "last_name": _pick(LAST_NAMES, key),
        "first_name_shipping": _pick(FIRST_NAMES, key),
        "last_name_shipping": _pick(LAST_NAMES, key),
        "phone_billing": F.concat(F.lit("+36-"), F.col("c_custkey").cast("string")),
        "address_billing": F.concat(F.col("c_name"), F.lit(" utca 1")),
        "postcode_billing": F.lpad(F.pmod(key, F.lit(9000)).cast("string"), 4, "1"),
        "country_code_billing": F.lit("HU"),
    }


def customer_totals(orders: DataFrame) -> DataFrame:
    """Stored customer totals: count, Σ price, first and last order date per customer.

    A group-by with partial aggregation, so a customer holding a third of all
    orders is combined map-side before the shuffle.
    """
    return (orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("customer_total_orders"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("customer_total_spent"),
        F.min("o_orderdate").alias("customer_first_order"),
        F.max("o_orderdate").alias("customer_last_order"),
    ).withColumnRenamed("o_custkey", "t_custkey"))


def order_line_table(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Canonical raw order lines (all statuses) built from the test tables.

    ``columns``: canonical columns wanted; only the joins they need are made.
    Dimension joins are left joins from ``lineitem`` (lookups), so dropping
    an unneeded one never changes the rows. Join strategy is left to the
    planner: broadcast while a side's estimated size is under
    ``spark.sql.autoBroadcastJoinThreshold``, sort-merge beyond it, and AQE
    re-plans (and splits skewed partitions) at run time.
    """
    want = list(dict.fromkeys(columns or LINE_COLUMNS))
    need = set().union(*(_NEEDS.get(c, set()) for c in want)) | {"orders"}
    li = read_table(spark, sf_dir, "lineitem")
    df = li
    if "orders" in need:
        df = df.join(read_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    totals = "totals" in need
    if need & {"customer", "nation"}:
        customer = read_table(spark, sf_dir, "customer")
        if totals:      # one dimension, so that the lines are joined (and a large customer's split) once
            customer = customer.join(customer_totals(read_table(spark, sf_dir, "orders")), F.col("c_custkey") == F.col("t_custkey"), "left")
            totals = False
        df = df.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left")
    if "nation" in need:
        df = df.join(read_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    if "part" in need:
        df = df.join(read_table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    if totals:
        df = df.join(customer_totals(read_table(spark, sf_dir, "orders")),
                     F.col("o_custkey") == F.col("t_custkey"), "left")

    def price():
        return F.col("l_extendedprice").cast("decimal(18,2)")

    exprs = {
        "order_number": lambda: F.col("l_orderkey"),
        LINE_ORDINAL: lambda: F.col("l_orderkey") * F.lit(8) + F.col("l_linenumber"),
        "order_date": lambda: F.col("o_orderdate"),
        "order_status": lambda: F.col("o_orderstatus"),
        "city": lambda: F.col("n_name"),
        "email": lambda: F.concat(F.col("c_name"), F.lit("@example.com")),
        "line_total": price,
        "refund_amount": lambda: F.when(
            F.col("o_orderpriority") == "1-URGENT",
            F.col("o_totalprice").cast("decimal(18,2)") * F.lit(0.05).cast("decimal(3,2)"))
            .otherwise(F.lit(0).cast("decimal(3,2)")),
        "discount_amount": lambda: price() * F.col("l_discount").cast("decimal(4,2)"),
        "item_id": lambda: F.col("l_partkey"),
        "item_name": lambda: F.col("p_name"),
        "quantity": lambda: F.col("l_quantity"),
        "stock_quantity": lambda: (F.col("p_size") % 10).cast("double"),
        "category_path": lambda: F.concat(F.lit("Shop > "), F.col("p_type"), F.lit(" > "),
                                          F.col("p_brand"), F.lit(" ")),
        "gender": lambda: F.col("c_mktsegment"),
        "origin": lambda: F.col("o_orderpriority"),
    }
    for c in ("customer_total_orders", "customer_total_spent", "customer_first_order", "customer_last_order"):
        exprs[c] = (lambda name: lambda: F.col(name))(c)
    names = [c for c in want if c in NAME_COLUMNS]
    named = customer_names(df) if names else {}
    out = []
    for c in want:
        if c in named:
            out.append(named[c].alias(c))
        elif c in exprs:
            out.append(exprs[c]().alias(c))
        else:
            raise KeyError(f"no binding for column {c!r}")
    return df.select(*out)


def city_county_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City -> county stand-in: nation name -> region name."""
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    return (nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("n_name").alias("city"), F.col("r_name").alias("county")))


def customer_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw customer records with stand-in personal columns (privacy binding)."""
    cust = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    df = cust.join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return df.select(
        F.col("c_custkey").alias("customer_id"),
        F.concat(F.col("c_name"), F.lit("@example.com")).alias("email"),
        F.col("n_name").alias("city"),
        *[e.alias(k) for k, e in customer_names(df).items()],
    )


def name_lists(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The fixed male/female name lists as one-column text frames (like S3's input)."""
    male = spark.createDataFrame([(v,) for v in MALE_NAMES], "value string")
    female = spark.createDataFrame([(v,) for v in FEMALE_NAMES], "value string")
    return male, female


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as completed order lines: ts -> order date, value -> line total, type -> origin."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("order_number"),
        F.col("event_id").alias(LINE_ORDINAL),
        F.col("ts").alias("order_date"),
        F.lit(COMPLETED).alias("order_status"),
        F.col("value").cast("decimal(18,2)").alias("line_total"),
        F.lit(0).cast("decimal(18,2)").alias("refund_amount"),
        F.lit(0).cast("decimal(18,2)").alias("discount_amount"),
        F.col("event_type").alias("origin"),
        F.col("user_id").cast("string").alias("email"),
    )

"""Edge cases from FIXTURES.md §1-§4 on hand-made lines."""

import datetime as dt

from pyspark.sql import functions as F

from basketlens import Params
from basketlens.operators import audience, discounts, inventory, region, revenue

SCHEMA = ("order_number string, line_no int, order_date timestamp_ntz, city string, item_id string, "
          "item_name string, quantity double, stock_quantity double, gender string, r double, d double")


def lines(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"year": F.year("order_date"), "line_revenue": F.col("r").cast("decimal(29,6)"),
                           "discount_amount": F.col("d").cast("decimal(18,4)")})


def ts(y, m=1, d=1):
    return dt.datetime(y, m, d)


def test_regional_duplicates_unmapped_and_null_cities(spark):
    rows = [("1", 1, ts(2024), "Pécs", "a", "A", 1.0, 1.0, "x", 100.0, 0.0),
            ("2", 2, ts(2024), "Győr", "a", "A", 1.0, 1.0, "x", 50.0, 0.0),
            ("3", 3, ts(2024), "Nowhere", "a", "A", 1.0, 1.0, "x", 70.0, 0.0),
            ("4", 4, ts(2024), None, "a", "A", 1.0, 1.0, "x", 30.0, 0.0),
            ("5", 5, ts(2023), "Pécs", "a", "A", 1.0, 1.0, "x", 5.0, 0.0),
            ("6", 6, ts(2022), "Pécs", "a", "A", 1.0, 1.0, "x", 1.0, 0.0),
            (None, 7, ts(2025), "Pécs", "a", "A", 1.0, 1.0, "x", 9.0, 0.0)]   # no order number: not an order year
    cities = spark.createDataFrame([("Pécs", "Baranya"), ("Pécs", "Baranya"), ("Győr", "GyMS"), (None, "X")],
                                   "city string, county string")
    reg = {(r["year"], r["county"], r["city"]): float(r["revenue"])
           for r in region.regional_revenue(lines(spark, rows), cities, Params()).collect()}
    # duplicate map rows count the city twice, as a line-level left join does
    assert reg == {(2024, "Baranya", "Pécs"): 200.0, (2024, "GyMS", "Győr"): 50.0, (2023, "Baranya", "Pécs"): 10.0}


def test_one_item_id_two_names(spark):
    rows = [("1", 1, ts(2024), "c", "77", "Mug", 2.0, 5.0, "x", 10.0, 0.0),
            ("2", 2, ts(2024), "c", "77", "Big mug", 1.0, 9.0, "x", 20.0, 0.0)]
    top = revenue.top_products(lines(spark, rows), Params()).collect()
    assert [(r["item_id"], r["item_name"], r["revenue"]) for r in top] == [("77", "Mug", 30)]
    items = inventory.item_sales(lines(spark, rows), Params(as_of=ts(2024, 6))).collect()
    assert sorted((r["item_name"], r["quantity"], r["stock_quantity"]) for r in items) == [
        ("Big mug", 1.0, 9.0), ("Mug", 2.0, 5.0)]


def test_single_year_kept(spark):
    rows = [("1", 1, ts(2024, 3, 4), "c", "a", "A", 1.0, 1.0, "x", 10.0, 0.0)]
    df = lines(spark, rows).withColumn("category_path", F.lit("A > B"))
    assert [r["year"] for r in revenue.category_revenue(df, Params()).collect()] == [2024]
    got = revenue.category_shares(df, Params()).collect()
    assert sorted((r["last_category"], r["revenue"], r["percentage"]) for r in got) == [
        ("B", 10, 100.0), ("Minden más", 0, 0.0)]


def test_discounts_null_order_numbers(spark):
    rows = [("1", 1, ts(2024), "c", "a", "A", 1.0, 1.0, "x", 10.0, 2.0),
            ("1", 2, ts(2024), "c", "a", "A", 1.0, 1.0, "x", 10.0, 3.0),
            (None, 3, ts(2024), "c", "a", "A", 1.0, 1.0, "x", 10.0, 4.0),
            ("2", 4, ts(2024), "c", "a", "A", 1.0, 1.0, "x", 10.0, 0.0)]
    r = discounts.discount_summary(lines(spark, rows)).first()
    assert (r["year"], r["discount_total"], r["discounted_orders"]) == (2024, 9.0, 1)


def test_gender_summary_and_share_skip_nulls(spark):
    rows = [("1", 1, ts(2024), "c", "a", "A", 1.0, 1.0, "Nő", 10.0, 0.0),
            ("1", 2, ts(2024), "c", "a", "A", 1.0, 1.0, "Nő", 5.0, 0.0),
            ("2", 3, ts(2024), "c", "a", "A", 1.0, 1.0, "Férfi", 1.0, 0.0),
            ("3", 4, ts(2024), "c", "a", "A", 1.0, 1.0, None, 7.0, 0.0)]
    share = {r["gender"]: r["share"] for r in audience.gender_share(lines(spark, rows)).collect()}
    assert share == {"Nő": (2 / 3) * 100, "Férfi": (1 / 3) * 100}   # pandas: (n / total) * 100
    summ = {r["gender"]: (r["orders"], r["revenue"]) for r in audience.gender_summary(lines(spark, rows)).collect()}
    assert summ == {"Nő": (1, 15.0), "Férfi": (1, 1.0)}

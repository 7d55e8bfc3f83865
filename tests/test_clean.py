import datetime as dt

import pytest
from pyspark.sql import functions as F

from basketlens import Params
from basketlens.operators import clean
from basketlens.sources.readers import canonical_names

HEADERS = ["Order Number", "Order Date", "Order Status", "Order Line Total (include tax)",
           "Order Refund Amount", "Item Discount Amount", "Item ID", "Item Name", "Quantity", "line_no"]


def export(spark, rows):
    ddl = ", ".join(f"`{h}` string" for h in HEADERS[:-1]) + ", line_no int"
    return canonical_names(spark.createDataFrame(rows, ddl))


def test_order_lines_filter_coerce_derive(spark):
    ok = "Teljesítve"
    rows = [
        ("1001", "2024-03-05 14:20", ok, "12990", None, "300", "77", "Mug", "2", 1),
        ("1001", "2024-03-05 14:20", ok, "x", "500", None, "78", "Cup", "1", 2),
        ("1002", "bad", ok, " 2 ", "0", "0", "77", "Mug", "1", 3),
        ("1003", "2024-04-01 10:00", "Törölve", "999", "0", "0", "77", "Mug", "1", 4),
    ]
    lines = clean.order_lines(export(spark, rows), Params())
    got = lines.orderBy("line_no").select("order_number", "year", "month", "line_revenue").collect()
    assert [(r[0], r[1], r[2], float(r[3])) for r in got] == [
        ("1001", 2024, 3, 12690.0), ("1001", 2024, 3, 0.0), ("1002", None, None, 2.0)]


def test_order_totals_first_refund_is_first_non_null_after_coercion(spark):
    ok = "Teljesítve"
    rows = [("1", "2024-01-01", ok, "100", None, "0", "1", "A", "1", 1),
            ("1", "2024-01-01", ok, "50", "20", "0", "2", "B", "1", 2),
            (None, "2024-01-01", ok, "7", "0", "0", "3", "C", "1", 3)]
    orders = clean.order_totals(clean.order_lines(export(spark, rows), Params())).collect()
    assert len(orders) == 1   # null order numbers leave the roll-up
    r = orders[0]
    # a null refund is 0 after coercion, so the first refund is 0, not 20
    assert (float(r["line_revenue"]), float(r["refund_amount"]), float(r["net_revenue"])) == (150.0, 0.0, 150.0)
    assert r["order_date"] == dt.datetime(2024, 1, 1)


def test_missing_columns_and_required(spark):
    df = export(spark, [])
    missing = clean.missing_columns(df)
    assert "email" in missing and "order_number" not in missing
    with pytest.raises(ValueError):
        clean.order_lines(df.drop("refund_amount"), Params())
    assert clean.missing_columns_frame(spark, df).count() == len(missing)


def test_keep_known_columns_drops_unlisted(spark):
    df = export(spark, []).withColumn("junk", F.lit(1))
    assert "junk" not in clean.keep_known_columns(df).columns


def test_stated_date_format(spark):
    ok = "Teljesítve"
    rows = [("1", "2024.03.05 14:20", ok, "1", "0", "0", "1", "A", "1", 1),
            ("2", "2024-03-05 14:20", ok, "1", "0", "0", "1", "A", "1", 2)]
    lines = clean.order_lines(export(spark, rows), Params(date_format="yyyy.MM.dd HH:mm"))
    got = {r["order_number"]: r["order_date"] for r in lines.collect()}
    assert got == {"1": dt.datetime(2024, 3, 5, 14, 20), "2": None}


def test_params_validation():
    assert Params(k=2).k == 2
    for bad in ({"k": 0}, {"recent_years": 0}, {"high_quantile": 1.5}, {"mask_digits": 65}, {"tol": -1.0}):
        with pytest.raises(ValueError):
            Params(**bad)

"""Exports with different headers, types and columns become one frame."""

import datetime as dt
from decimal import Decimal

import pytest

from basketlens.operators import clean
from basketlens.schema import Params
from basketlens.sources.readers import read_order_lines
from basketlens.sources.reconcile import column_votes, conflicts, plain_header, reconcile


def exports(spark):
    one = spark.createDataFrame([(1, dt.datetime(2024, 3, 5, 10), Decimal("10.50"), "007"), (2, None, None, None)],
                                "`Order Number` long, `Order Date` timestamp_ntz, `Item Discount Amount` decimal(10,2), SKU string")
    two = spark.createDataFrame([(" 3 ", "2024-03-06", "1.25", "x9", "a"), ("", None, " ", "12", "b")],
                                "`order number` string, order_date string, `ITEM DISCOUNT AMOUNT` string, sku string, Extra string")
    three = spark.createDataFrame([(4, None, 7), (None, 5, None)], "`Order Number` int, ` Order  number` int, extra int")
    return {"one": one, "two": two, "three": three}


def test_three_exports_give_one_frame(spark):
    frame, odd = reconcile(spark, exports(spark))
    assert dict(frame.dtypes) == {"export": "string", "order_number": "bigint", "order_date": "timestamp_ntz", "discount_amount": "decimal(38,10)",
                                  "sku": "string", "extra": "string"}
    got = sorted((tuple(r) for r in frame.collect()), key=repr)
    day = dt.datetime(2024, 3, 5, 10)
    assert got == sorted([("one", 1, day, Decimal("10.50"), "007", None), ("one", 2, None, None, None, None),
                          ("two", 3, dt.datetime(2024, 3, 6), Decimal("1.25"), "x9", "a"), ("two", None, None, None, "12", "b"),
                          ("three", 4, None, None, None, "7"), ("three", 5, None, None, None, None)], key=repr)
    report = {r.column: r[1:] for r in odd.collect()}
    assert report["order_number"] == ("bigint", 3, 3, 0, 0) and report["order_date"] == ("timestamp_ntz", 2, 2, 1, 0)
    assert report["sku"] == ("string", 2, 1, 1, 2) and report["extra"] == ("string", 2, 2, 1, 2)


def test_like_exports_have_no_conflicts_and_empties_count_as_missing(spark):
    df = exports(spark)["one"]
    votes = column_votes(spark, {"a": df, "b": df})
    assert conflicts(votes, 2).where("column != 'sku'").count() == 0
    frame, odd = reconcile(spark, {"a": df.limit(0), "b": spark.createDataFrame([], "other string")})
    assert frame.count() == 0 and set(frame.columns) == {"export", "order_number", "order_date", "discount_amount", "sku", "other"}
    assert {r.column: r.n_missing for r in odd.collect()} == dict.fromkeys(("order_number", "order_date", "discount_amount", "sku", "other"), 1)
    with pytest.raises(ValueError):
        reconcile(spark, {})


@pytest.mark.parametrize("text,kind", [("12", "bigint"), ("012", "string"), ("0", "bigint"), ("-3.50", "decimal(38,10)"), ("1e5", "string"), ("2024-01-02 03:04", "timestamp_ntz"),
                                       ("99999999999999999999", "decimal(38,10)"), ("0.12345678901", "string"), ("NaN", "string"), ("12:30", "string")])
def test_type_of_one_text(spark, text, kind):
    frame, _ = reconcile(spark, {"a": spark.createDataFrame([(text,)], "v string")})
    assert dict(frame.dtypes)["v"] == kind and str(frame.first().v) != "None"


def test_doubles_stay_doubles_where_nothing_is_lost(spark):
    one = spark.createDataFrame([(0.1, 1.5)], "a double, b double")
    two = spark.createDataFrame([("12.25", 2 ** 60)], "a string, b long")
    frame, odd = reconcile(spark, {"one": one, "two": two})
    assert dict(frame.dtypes)["a"] == "double" and dict(frame.dtypes)["b"] == "string"
    assert sorted((r.a, r.b) for r in frame.collect()) == [(0.1, "1.5"), (12.25, str(2 ** 60))]
    assert {r.column: r.n_text for r in odd.collect()} == {"a": 0, "b": 1}


def test_plain_headers():
    assert plain_header(" Order_Number ") == plain_header("order  number") == "ordernumber"


def test_csv_exports_feed_the_cleaning_step(spark, tmpdir_run):
    head = "Order Number,Order Date,Order Status,Order Line Total (include tax),Order Refund Amount,Item Discount Amount"
    texts = [head + "\n1,2024-01-02,Teljesítve,10.5,0,1\n", head.upper() + ",City (Billing)\n2,2024-02-03 10:00,Teljesítve,7,1,0,Pécs\n"]
    frames = {}
    for i, text in enumerate(texts):
        path = f"{tmpdir_run}/{i}.csv"
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        frames[str(i)] = read_order_lines(spark, path, "csv")
    frame, _ = reconcile(spark, frames)
    done = clean.order_lines(frame, Params()).select("order_number", "year", "month", "line_revenue", "city", "line_no").orderBy("order_number").collect()
    assert [tuple(r)[:5] for r in done] == [(1, 2024, 1, Decimal("9.5"), None), (2, 2024, 2, Decimal("7"), "Pécs")]
    assert all(r.line_no["file"].endswith(".csv") for r in done)

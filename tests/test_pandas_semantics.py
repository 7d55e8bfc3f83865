"""Brute-force semantic check with pandas (the reference's engine) on sf0.001.

Each report is recomputed with plain pandas operations in float64 on the
bound order lines (groupby with null keys dropped, first, nlargest,
value_counts(normalize=True), quantile) and compared with the Spark output.
Money differs only by float summation order, so values are compared with a
tolerance; rounded integers and labels must be equal.
"""

import datetime as dt
import os

import numpy as np
import pandas as pd
import pytest

from basketlens.plans import catalog as C

SF = os.environ.get("BASKETLENS_PANDAS_SF", "/root/testdata/sf0.001")
AS_OF = pd.Timestamp(dt.datetime(2001, 8, 1))


@pytest.fixture(scope="module")
def pdf(spark):
    cols = ["city", "email", "customer_total_spent", "customer_total_orders", "customer_first_order",
            "customer_last_order", "item_id", "item_name", "quantity", "stock_quantity", "category_path", "gender"]
    df = C.lines(spark, SF, *cols).toPandas()
    for c in ("line_total", "refund_amount", "discount_amount", "line_revenue", "customer_total_spent"):
        df[c] = df[c].astype(float)
    return df.sort_values("line_no", kind="stable").reset_index(drop=True)


def close(a, b):
    return np.isclose(a, b, rtol=1e-9, atol=1e-6)


def test_monthly(spark, pdf):
    orders = pdf.groupby("order_number").agg({"line_revenue": "sum", "refund_amount": "first", "year": "first",
                                              "month": "first"}).reset_index()
    orders["net"] = orders["line_revenue"] - orders["refund_amount"]
    want = orders.groupby(["year", "month"])["net"].sum()
    got = {(r["year"], r["month"]): r["net_revenue"] for r in C.QUERIES["monthly_revenue"](spark, SF).collect()}
    assert set(got) == set(want.index)
    assert all(close(got[k], v) for k, v in want.items())


def test_category_shares(spark, pdf):
    years = sorted(pdf["year"].dropna().unique())[-2:]
    rec = pdf[pdf["year"].isin(years)].copy()
    rec["cat"] = rec["category_path"].str.split(">").str[-1].str.strip()
    cat = rec.groupby(["year", "cat"]).agg({"line_revenue": "sum"}).reset_index()
    total = cat.groupby("year")["line_revenue"].sum().to_dict()
    got = {(r["year"], r["last_category"]): (r["revenue"], r["percentage"])
           for r in C.QUERIES["category_shares"](spark, SF).collect()}
    for y in years:
        part = cat[cat["year"] == y].sort_values("cat").nlargest(8, "line_revenue")
        rest = total[y] - part["line_revenue"].sum()
        rows = list(zip(part["cat"], part["line_revenue"])) + [("Minden más", rest)]
        assert {k for (yy, k) in got if yy == y} == {c for c, _ in rows}
        for c, v in rows:
            rev, p = got[(y, c)]
            assert rev == int(np.round(v, 0)) and p == np.round(v / total[y] * 100, 1)


def test_top_products(spark, pdf):
    years = sorted(pdf["year"].dropna().unique())[-2:]
    rec = pdf[pdf["year"].isin(years)]
    prod = rec.groupby(["year", "item_id"]).agg({"line_revenue": "sum", "item_name": "first"}).reset_index()
    prod["line_revenue"] = prod["line_revenue"].round(0).astype(int)
    got = {(r["year"], r["item_id"]): (r["item_name"], r["revenue"])
           for r in C.QUERIES["top_products"](spark, SF).collect()}
    for y in years:
        top = prod[prod["year"] == y].nlargest(8, "line_revenue")
        assert {(y, i): (n, v) for i, n, v in zip(top["item_id"], top["item_name"], top["line_revenue"])} == \
            {k: v for k, v in got.items() if k[0] == y}


def test_stock(spark, pdf):
    rec = pdf[pdf["order_date"] >= AS_OF - pd.Timedelta(days=365)]
    s = rec.groupby(["item_id", "item_name"]).agg({"quantity": "sum", "stock_quantity": "first"}).reset_index()
    s["daily"] = s["quantity"] / 365
    hi, lo = s["daily"].quantile(0.8), s["daily"].quantile(0.2)
    th = C.QUERIES["stock_thresholds"](spark, SF).first()
    assert (th["q_high"], th["q_low"]) == (hi, lo)
    low = s[(s["daily"] > hi) & (s["stock_quantity"] < s["daily"] * 7)]
    exc = s[(s["daily"] <= lo) & (s["stock_quantity"] > s["daily"] * 90)]
    assert {r["item_id"] for r in C.QUERIES["low_stock"](spark, SF).collect()} == set(low["item_id"])
    assert {r["item_id"] for r in C.QUERIES["excess_stock"](spark, SF).collect()} == set(exc["item_id"])


def test_discounts_weekday_gender(spark, pdf):
    d = pdf[pdf["discount_amount"] > 0].groupby("year").agg({"discount_amount": "sum", "order_number": "nunique"})
    got = {r["year"]: (r["discount_total"], r["discounted_orders"]) for r in C.QUERIES["discount_summary"](spark, SF).collect()}
    assert all(close(got[y][0], v["discount_amount"]) and got[y][1] == v["order_number"] for y, v in d.iterrows())
    years = sorted(pdf["year"].dropna().unique())[-2:]
    rec = pdf[pdf["year"].isin(years)].copy()
    rec["wd"] = rec["order_date"].dt.day_name()
    wd = rec.groupby(["year", "wd"])["line_revenue"].sum()
    got = {(r["year"], r["weekday"]): r["revenue"] for r in C.QUERIES["weekday_revenue"](spark, SF).collect()}
    assert set(got) == set(wd.index) and all(close(got[k], v) for k, v in wd.items())
    share = pdf["gender"].value_counts(normalize=True) * 100
    got = {r["gender"]: r["share"] for r in C.QUERIES["gender_share"](spark, SF).collect()}
    assert got == share.to_dict()


def test_customer_features(spark, pdf):
    agg = pdf.groupby("email").agg({"customer_total_orders": "sum", "line_revenue": "sum",
                                    "customer_first_order": "min", "customer_last_order": "max"})
    agg = agg[AS_OF - agg["customer_last_order"] <= pd.Timedelta(days=365)]
    rec = (AS_OF - agg["customer_last_order"]).dt.days
    got = {r["email"]: r for r in C.QUERIES["customer_features_active"](spark, SF).collect()}
    assert set(got) == set(agg.index)
    for e, row in agg.iterrows():
        g = got[e]
        assert g["total_orders"] == row["customer_total_orders"] and close(g["total_spent"], row["line_revenue"])
        assert g["recency_days"] == rec[e] and close(g["order_frequency"], row["customer_total_orders"] / 365)


def test_origin_folded_on_events(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    ev = ev[ev["ts"].dt.year >= 2024]
    dist = ev["event_type"].value_counts(normalize=True) * 100
    major, minor = dist[dist >= C.ORIGIN_FOLD_THRESHOLD], dist[dist < C.ORIGIN_FOLD_THRESHOLD]
    want = major.to_dict()
    if not minor.empty:
        want["Egyéb"] = minor.sum()
    got = {r["origin"]: r["share"] for r in C.QUERIES["origin_folded"](spark, SF).collect()}
    assert set(got) == set(want) and all(close(got[k], v) for k, v in want.items())

"""Randomised checks: operators against a pandas brute force on generated lines."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from basketlens import Params
from basketlens.operators import ranking, revenue

CATS = ["A > x", "A > y", "B > x", "z", "C > w ", "D > v", "E > u", "F > t", "G > s", "H > r", None]

line = st.tuples(st.integers(2019, 2024), st.sampled_from(CATS), st.integers(0, 400),
                 st.integers(0, 9999).map(lambda c: Decimal(c) / 100))


def frame(spark, rows):
    data = [(f"o{i % 7}", i, dt.datetime(y, 3, 1), c, f"i{item}", f"name{item}", v)
            for i, (y, c, item, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "order_number string, line_no int, order_date timestamp_ntz, "
                                     "category_path string, item_id string, item_name string, v decimal(18,2)")
    return df.withColumns({"year": F.year("order_date"), "line_revenue": F.col("v").cast("decimal(29,6)")})


SETTINGS = dict(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@settings(**SETTINGS)
@given(st.lists(line, min_size=1, max_size=60))
def test_category_shares_random(spark, rows):
    got = {(r["year"], r["last_category"]): (r["revenue"], r["percentage"], r["rank"])
           for r in revenue.category_shares(frame(spark, rows), Params()).collect()}
    pdf = pd.DataFrame(rows, columns=["year", "cat", "item", "v"])
    pdf["v"] = pdf["v"].map(Decimal)
    years = sorted(pdf["year"].unique())[-2:]
    rec = pdf[pdf["year"].isin(years)].copy()
    rec["last"] = rec["cat"].str.split(">").str[-1].str.strip()
    cat = rec.dropna(subset=["last"]).groupby(["year", "last"])["v"].sum().reset_index()
    want = {}
    for y in years:
        part = cat[cat["year"] == y].sort_values("last")
        if part.empty:
            continue
        total = part["v"].sum()
        order = sorted(zip(part["last"], part["v"]), key=lambda t: (-t[1], t[0]))[:8]
        rest = total - sum(v for _, v in order)
        for k, (c, v) in enumerate(order, 1):
            want[(y, c)] = (int(v.quantize(Decimal(1), "ROUND_HALF_EVEN")), k)
        want[(y, "Minden más")] = (int(rest.quantize(Decimal(1), "ROUND_HALF_EVEN")), len(order) + 1)
    assert {k: (v[0], v[2]) for k, v in got.items()} == want
    for (y, c), (_, p, _) in got.items():
        tot = float(cat[cat["year"] == y]["v"].sum())
        v = float(cat[(cat["year"] == y) & (cat["last"] == c)]["v"].sum()) if c != "Minden más" else \
            tot - sum(float(x) for x in sorted(cat[cat["year"] == y]["v"], reverse=True)[:8])
        if tot:
            assert abs(p - round(v / tot * 100, 1)) < 0.05 + 1e-9


@settings(**SETTINGS)
@given(st.lists(line, min_size=1, max_size=60))
def test_top_products_random(spark, rows):
    got = {(r["year"], r["item_id"]): r["revenue"] for r in revenue.top_products(frame(spark, rows), Params()).collect()}
    pdf = pd.DataFrame(rows, columns=["year", "cat", "item", "v"])
    years = sorted(pdf["year"].unique())[-2:]
    rec = pdf[pdf["year"].isin(years)].copy()
    rec["item_id"] = "i" + rec["item"].astype(str)
    prod = rec.groupby(["year", "item_id"])["v"].sum().reset_index()
    prod["r"] = prod["v"].map(lambda d: int(Decimal(d).quantize(Decimal(1), "ROUND_HALF_EVEN")))
    want = {}
    for y in years:
        part = sorted(((r, i) for i, r in zip(prod[prod["year"] == y]["item_id"], prod[prod["year"] == y]["r"])),
                      key=lambda t: (-t[0], t[1]))[:8]
        want.update({(y, i): r for r, i in part})
    assert got == want


@settings(**SETTINGS)
@given(st.lists(st.sampled_from(["g", "b", "y", "d", "x", None]), min_size=1, max_size=300),
       st.sampled_from([1.0, 5.0, 20.0, 50.0]))
def test_value_shares_and_fold_random(spark, vals, threshold):
    df = spark.createDataFrame([(v,) for v in vals], "origin string")
    s = pd.Series(vals, dtype=object).dropna()
    shares = ranking.value_shares(df, "origin")
    got = {r["origin"]: r["share"] for r in shares.collect()}
    want = (s.value_counts(normalize=True) * 100).to_dict() if len(s) else {}
    assert set(got) == set(want) and all(np.isclose(got[k], want[k], rtol=1e-12) for k in want)
    folded = {r["origin"]: r["share"] for r in
              ranking.fold_small_shares(shares, "origin", threshold, "Egyéb").collect()}
    major = {k: v for k, v in want.items() if v >= threshold}
    minor = {k: v for k, v in want.items() if v < threshold}
    if minor:
        major["Egyéb"] = sum(minor.values())
    assert set(folded) == set(major) and all(np.isclose(folded[k], major[k], rtol=1e-9) for k in major)

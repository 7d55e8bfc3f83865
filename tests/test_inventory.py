import datetime as dt
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from basketlens import Params
from basketlens.functions.quantiles import exact_quantiles
from basketlens.operators import inventory


def test_quantile_linear(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double")
    r = exact_quantiles(df, "v", {"a": 0.8, "b": 0.2, "c": 0.5, "d": 1.0, "e": 0.0}).first()
    want = [float(np.quantile([1.0, 2.0, 3.0, 4.0], q)) for q in (0.8, 0.2, 0.5, 1.0, 0.0)]
    assert [r["a"], r["b"], r["c"], r["d"], r["e"]] == want
    assert abs(r["a"] - 3.4) < 1e-12


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=0, max_value=60), min_size=1, max_size=40),
       st.sampled_from([0.2, 0.8, 0.33, 0.5, 0.95]))
def test_quantile_matches_numpy(spark, ints, q):
    vals = [i / 365 for i in ints]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    got = exact_quantiles(df, "v", {"q": q}).first()["q"]
    assert got == float(np.quantile(np.array(vals), q))


def _lines(spark, rows):
    data = [(dt.datetime(2001, 7, 1), iid, name, qty, stock, i) for i, (iid, name, qty, stock) in enumerate(rows)]
    return spark.createDataFrame(
        data, "order_date timestamp_ntz, item_id string, item_name string, quantity double, stock_quantity double, line_no int")


def test_stock_flags_and_counts(spark):
    random.seed(1)
    rows = [(f"i{k}", f"n{k}", float(k * 30), 1000.0) for k in range(1, 11)]
    rows += [("i10", "n10", 0.0, 0.0), ("i1", "n1", None, 5.0)]
    params = Params(as_of=dt.datetime(2001, 8, 1))
    items = inventory.item_sales(_lines(spark, rows), params)
    got = {r["item_id"]: r for r in items.collect()}
    assert got["i1"]["quantity"] == 30.0 and got["i1"]["stock_quantity"] == 1000.0
    flags = inventory.stock_flags(items, params)
    counts = inventory.stock_risk_counts(flags).first()
    low = {r["item_id"] for r in inventory.low_stock(flags).collect()}
    excess = {r["item_id"] for r in inventory.excess_stock(flags).collect()}
    assert low == set()           # stock 1000 is more than 7 days everywhere
    assert excess == {"i1", "i2"}  # lowest 20 % of sellers with > 90 days of stock
    assert (counts["low_stock_items"], counts["excess_stock_items"]) == (0, 2)


def test_trailing_window_excludes_old_orders(spark):
    data = [(dt.datetime(2000, 7, 31), "a", "A", 5.0, 1.0, 0), (dt.datetime(2000, 8, 1), "a", "A", 2.0, 1.0, 1)]
    df = spark.createDataFrame(
        data, "order_date timestamp_ntz, item_id string, item_name string, quantity double, stock_quantity double, line_no int")
    r = inventory.item_sales(df, Params(as_of=dt.datetime(2001, 8, 1))).first()
    assert r["quantity"] == 2.0


def test_approx_thresholds_close_to_exact(spark):
    from basketlens.plans import catalog as C
    items = C.q_item_sales(spark, "/root/testdata/sf0.01")
    exact = inventory.stock_thresholds(items, C.P).first()
    approx = inventory.stock_thresholds(items, C.P.with_(approx_quantiles=True)).first()
    step = 1 / 365    # daily averages are whole quantities / 365
    assert abs(exact["q_high"] - approx["q_high"]) <= step and abs(exact["q_low"] - approx["q_low"]) <= step

"""The one-scan frame: its slices equal the operators that read the lines for themselves."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketlens import Params
from basketlens.operators import clean, inventory, region, revenue, segments
from basketlens.plans import bundle, catalog, grains
from basketlens.sources import tables

SF = "/root/testdata/sf0.001"
P = Params(as_of=dt.datetime(2024, 6, 1))


@pytest.fixture(scope="module")
def lines(spark):
    """Lines with nulls in every key, ties, and orders whose lines differ in date and refund."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(900):
        day = dt.datetime(2022, 1, 1) + dt.timedelta(hours=int(rng.integers(0, 21_000)))
        none = lambda p, v: None if rng.random() < p else v
        rows.append((i, none(.1, f"o{int(rng.integers(250))}"), none(.05, day), none(.1, f"c{int(rng.integers(7))}"), none(.1, f"m{int(rng.integers(40))}"), none(.2, int(rng.integers(12))),
                     none(.2, f"n{int(rng.integers(15))}"), none(.1, float(rng.integers(1, 5))), none(.3, float(rng.integers(0, 90))), none(.1, f"a > b{int(rng.integers(12))} "),
                     none(.2, round(float(rng.random()) * 100, 2)), none(.3, float(rng.integers(0, 9))), none(.5, 1.5), int(rng.integers(1, 5)), 1000.5, day, day))
    raw = spark.createDataFrame(rows, "line_no long, order_number string, order_date timestamp_ntz, city string, email string, item_id int, item_name string, quantity double, stock_quantity double, "
                                      "category_path string, line_total double, refund_amount double, discount_amount double, customer_total_orders int, customer_total_spent double, "
                                      "customer_first_order timestamp_ntz, customer_last_order timestamp_ntz").withColumn("order_status", F.lit(P.completed_status))
    return clean.order_lines(raw, P).persist()


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = [sorted(map(tuple, x.select(*cols).collect()), key=str) for x in (a, b)]
    assert rows[0] == rows[1] and rows[0]


@pytest.mark.parametrize("dedupe", [False, True])
def test_slices_equal_the_operators(spark, lines, dedupe):
    p = P.with_(dedupe_customer_totals=dedupe)
    cities = spark.createDataFrame([(f"c{i}", f"k{i % 3}") for i in range(5)] + [("c1", "k9"), (None, "k0"), ("c6", None)], "city string, county string")
    g = grains.grains(lines, p).persist()
    same(grains.orders(g), clean.order_totals(lines))
    same(grains.category_revenue(g, p), revenue.category_revenue(lines, p))
    same(grains.product_revenue(g, p), revenue.product_revenue(lines, p))
    same(grains.item_sales(g, p), inventory.item_sales(lines, p))
    same(grains.regional_revenue(g, cities, p), region.regional_revenue(lines, cities, p))
    for variant in ("active", "all"):
        same(grains.customer_features(g, p, variant), segments.customer_features(lines, p, variant))
    g.unpersist()


def test_no_lines(spark, lines):
    g = grains.grains(lines.limit(0), P)
    assert grains.orders(g).count() == grains.product_revenue(g, P).count() == grains.item_sales(g, P).count() == 0


def test_the_bundle_scans_the_lines_once(spark):
    df = grains.grains(catalog.lines(spark, SF, *catalog.BUNDLE_COLUMNS), catalog.P)
    assert df._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet") == 1
    b = bundle.report_bundle(catalog.lines(spark, SF, *catalog.BUNDLE_COLUMNS), tables.city_county_table(spark, SF), catalog.P)
    held = b["_persisted"][0]
    assert held.storageLevel.useMemory
    for name, table in b.items():
        if name not in ("_persisted", "cluster_summary"):
            assert table.count() > 0
            assert "InMemoryTableScan" in table._jdf.queryExecution().executedPlan().toString()      # every table reads the one frame
    bundle.release(b)


def test_an_ordinal_is_needed(spark, lines):
    with pytest.raises(ValueError):
        grains.grains(lines.drop("line_no"), P)

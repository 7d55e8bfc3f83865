"""Money bounds, CSV line order, released caches and segment checks."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from basketlens import Params
from basketlens.functions.columns import first_non_null, money
from basketlens.operators import clean, inventory, revenue, segments
from basketlens.plans import catalog as C
from basketlens.plans.bundle import release, report_bundle
from basketlens.plans.reports import bound_reports
from basketlens.sources import tables
from basketlens.sources.readers import read_order_lines

SF = "/root/testdata/sf0.001"


def amounts(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [str(r["m"]) for r in df.select(money("v").alias("m")).collect()]


def test_money_keeps_large_and_fine_amounts(spark):
    assert amounts(spark, ["100000000000000", "12.345678", "-0.000001", "junk", None, "", "NaN", " 7 "]) == [
        "100000000000000.000000", "12.345678", "-0.000001", "0.000000", "0.000000", "0.000000", "0.000000", "7.000000"]


@pytest.mark.parametrize("value", ["1e30", "9" * 40, "Infinity"])
def test_money_that_does_not_fit_is_an_error(spark, value):
    with pytest.raises(Exception, match="does not fit"):
        amounts(spark, [value])


def test_average_order_value_is_not_rounded(spark):
    orders = spark.createDataFrame([(2024, 1, v) for v in (1, 1, 2)], "year int, month int, v int").withColumn("net_revenue", F.col("v").cast("decimal(38,6)"))
    assert revenue.average_order_value(orders).first()["avg_order_value"] == 4 / 3


HEADER = "order_number,order_status,order_date,line_total,refund_amount,discount_amount,item_id,item_name,quantity,stock_quantity,category_path"


def test_csv_first_is_first_in_file_order(spark, tmpdir_run):
    folder = tmpdir_run + "/csv"
    os.makedirs(folder)
    for part in range(6):
        with open(f"{folder}/part-{part}.csv", "w") as f:
            f.write(HEADER + "\n")
            for k in range(200):
                f.write(f"{k % 50},{Params().completed_status},2024-03-{part + 1:02d} 10:00:00,10,{part * 1000 + k},1,i{k % 7},name {k % 7},1,{part * 1000 + k},A > b\n")
    for size in ("1k", "4k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            lines = clean.order_lines(read_order_lines(spark, folder, fmt="csv"), Params(as_of=dt.datetime(2024, 6, 1)))
            got = {int(r["order_number"]): (int(r["refund_amount"]), r["order_date"].day) for r in clean.order_totals(lines).collect()}
            assert got == {k: (k, 1) for k in range(50)}
            assert {r["item_id"]: r["item_name"] for r in revenue.top_products(lines).collect()} == {f"i{k}": f"name {k}" for k in range(7)}
            items = inventory.item_sales(lines, Params(as_of=dt.datetime(2024, 6, 1))).collect()
            assert {r["item_id"]: r["stock_quantity"] for r in items} == {f"i{k}": float(k) for k in range(7)}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_first_needs_a_line_order(spark):
    with pytest.raises(ValueError, match="line ordinal"):
        first_non_null("x", spark.createDataFrame([(1,)], "x int"))


def cached(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


@pytest.mark.parametrize("name", ["R1_monthly_revenue", "R6_stock_risks", "R12_segments_all", "R14_anonymised_lines"])
def test_reports_release_what_they_cache(spark, name):
    before = cached(spark)
    report = bound_reports(spark, SF)[name]()
    for df in report.outputs.values():
        df.count()
    report.release()
    assert cached(spark) <= before


def test_bundle_releases_and_never_persists_lines(spark):
    before = cached(spark)
    lines = C.lines(spark, SF, "city", "category_path", "item_id", "item_name", "quantity", "stock_quantity", "email", "customer_total_orders",
                    "customer_total_spent", "customer_first_order", "customer_last_order")
    bundle = report_bundle(lines, tables.city_county_table(spark, SF), C.P)
    assert not lines.storageLevel.useMemory and not lines.storageLevel.useDisk
    for name, df in bundle.items():
        if not name.startswith("_"):
            df.count()
    release(bundle)
    assert cached(spark) <= before


def test_left_out_customers_are_counted(spark):
    rows = [(f"c{i}", i, float(i), i if i % 5 else None, 1.0) for i in range(20)]
    features = spark.createDataFrame(rows, "email string, total_orders long, total_spent double, recency_days long, order_frequency double")
    seg = segments.segment(features, segments.ACTIVE_FEATURES, Params())
    check = segments.segment_check(seg).first()
    assert (check["customers"], check["left_out"], check["k"], check["clustered"]) == (20, 4, 4, 16)
    assert check["inertia"] == seg.fit.inertia > 0
    seg.release()


def test_building_the_anonymiser_starts_no_job(spark):
    from basketlens.plans.catalog import q_anonymised_lines
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("anonymiser", "build")
    try:
        df = q_anonymised_lines(spark, SF)
        assert len(tracker.getJobIdsForGroup("anonymiser")) == 0
        text = df._jdf.queryExecution().executedPlan().toString()
        assert text.count("lineitem.parquet") == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

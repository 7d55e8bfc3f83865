import datetime as dt

from pyspark.sql import functions as F

from basketlens import Params
from basketlens.operators import ranking, revenue


def test_top_n_ties_go_to_smaller_key(spark):
    rows = [(2024, f"c{i}", float(100 - i)) for i in range(7)] + [(2024, "c8", 10.0), (2024, "c7", 10.0)]
    df = spark.createDataFrame(rows, "year int, k string, v double")
    top = ranking.top_n_per_group(df, ["year"], [F.desc("v"), F.asc("k")], 8)
    keys = {r["k"] for r in top.collect()}
    assert "c7" in keys and "c8" not in keys and len(keys) == 8


def _lines(spark, rows):
    # rows: (year, category_path, line_revenue)
    data = [(f"o{i}", dt.datetime(y, 1, 1), p, float(v)) for i, (y, p, v) in enumerate(rows)]
    return (spark.createDataFrame(data, "order_number string, order_date timestamp_ntz, category_path string, r double")
            .withColumn("year", F.year("order_date"))
            .withColumn("line_revenue", F.col("r").cast("decimal(29,6)")))


def test_category_shares_rest_row_even_when_zero(spark):
    rows = [(2023, "A > x", 10), (2023, "A > y", 30), (2024, "B > x", 1), (2024, "B > y", 1), (2024, "z", 2)]
    got = revenue.category_shares(_lines(spark, rows), Params()).collect()
    by = {(r["year"], r["last_category"]): (r["revenue"], r["percentage"], r["rank"]) for r in got}
    assert by[(2023, "Minden más")] == (0, 0.0, 3)
    assert by[(2024, "Minden más")] == (0, 0.0, 4)
    assert by[(2023, "y")] == (30, 75.0, 1)
    assert by[(2024, "z")][1] == 50.0


def test_category_shares_top_eight_and_rest_sum_to_total(spark):
    rows = [(2024, f"c{i:02d}", i + 1) for i in range(12)]
    got = revenue.category_shares(_lines(spark, rows), Params()).collect()
    assert len(got) == 9
    assert sum(r["revenue"] for r in got) == sum(i + 1 for i in range(12))
    rest = [r for r in got if r["last_category"] == "Minden más"][0]
    assert rest["revenue"] == 1 + 2 + 3 + 4


def test_latest_years_only(spark):
    rows = [(2021, "a", 1), (2022, "a", 1), (2023, "a", 1)]
    got = revenue.category_revenue(_lines(spark, rows), Params()).collect()
    assert sorted(r["year"] for r in got) == [2022, 2023]


def test_value_shares_and_fold(spark):
    vals = ["google"] * 990 + ["bing"] * 9 + ["x"] * 1 + [None] * 50
    df = spark.createDataFrame([(v,) for v in vals], "origin string")
    shares = {r["origin"]: r["share"] for r in ranking.value_shares(df, "origin").collect()}
    assert abs(shares["google"] - 99.0) < 1e-12 and abs(shares["bing"] - 0.9) < 1e-12
    folded = {r["origin"]: r["share"] for r in
              ranking.fold_small_shares(ranking.value_shares(df, "origin"), "origin", 1.0, "Egyéb").collect()}
    assert set(folded) == {"google", "Egyéb"}
    assert abs(folded["Egyéb"] - 1.0) < 1e-12
    nothing = ranking.fold_small_shares(ranking.value_shares(df, "origin"), "origin", 0.01, "Egyéb").collect()
    assert {r["origin"] for r in nothing} == {"google", "bing", "x"}


def test_fold_replaces_major_label_row(spark):
    vals = ["Egyéb"] * 50 + ["a"] * 49 + ["b"]
    df = spark.createDataFrame([(v,) for v in vals], "origin string")
    folded = ranking.fold_small_shares(ranking.value_shares(df, "origin"), "origin", 1.5, "Egyéb").collect()
    got = {r["origin"]: r["share"] for r in folded}
    assert got == {"a": 49.0, "Egyéb": 1.0}


def test_head_with_remainder(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(23)], "item_id int, d double")
    head = ranking.head_with_remainder(df, [F.desc("d"), F.asc("item_id")], 10).collect()
    assert len(head) == 10 and all(r["more"] == 13 for r in head)
    assert [r["rank"] for r in sorted(head, key=lambda r: r["rank"])] == list(range(1, 11))
    small = ranking.head_with_remainder(df.limit(3), [F.asc("item_id")], 10).collect()
    assert len(small) == 3 and all(r["more"] == 0 for r in small)

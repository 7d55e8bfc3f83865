import datetime as dt

from pyspark.sql import functions as F

from basketlens.functions import columns as C


def one(spark, expr, value, ddl="x string"):
    return spark.createDataFrame([(value,)], ddl).select(expr.alias("r")).first()["r"]


def test_strip_unicode_whitespace(spark):
    assert one(spark, C.strip_ws("x"), "\t Anna  ") == "Anna"
    assert one(spark, C.strip_ws("x"), "\x1cAnna\x85") == "Anna"
    assert one(spark, C.strip_ws("x"), None) is None


def test_last_category(spark):
    cases = {"Home > Kitchen > Mugs": "Mugs", "Mugs": "Mugs", "A > ": "", "A|B": "A|B", "": "",
             "Shop > X > Brand#3 ": "Brand#3"}
    for src, want in cases.items():
        assert one(spark, C.last_category("x"), src) == want
    assert one(spark, C.last_category("x"), None) is None


def test_money_coercion(spark):
    df = spark.createDataFrame([("12990",), ("x",), ("1,5",), (" 2 ",), (None,)], "x string")
    got = [r["m"] for r in df.select(C.money("x").alias("m")).collect()]
    assert [float(v) for v in got] == [12990.0, 0.0, 0.0, 2.0, 0.0]


def test_days_between_floors(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 0), dt.datetime(2024, 1, 1, 1)),
                                (dt.datetime(2024, 1, 1, 0), dt.datetime(2024, 1, 1, 1)),
                                (dt.datetime(2024, 1, 3, 0), dt.datetime(2024, 1, 1, 0))],
                               "a timestamp_ntz, b timestamp_ntz")
    got = [r["d"] for r in df.select(C.days_between("a", "b").alias("d")).collect()]
    assert got == [0, -1, 2]


def test_format_amount(spark):
    assert one(spark, C.format_amount("x"), 1234.5, "x double") == "1,234.50"
    assert one(spark, C.format_amount("x", " Ft"), -1234567.125, "x double") == "-1,234,567.12 Ft"
    assert one(spark, C.format_amount("x"), None, "x double") == ""


def test_mask_email(spark):
    assert one(spark, C.mask_email("x"), "a@b.hu") == "5e1e7445a5@masked.com"
    assert one(spark, C.mask_email("x"), None) is None
    assert one(spark, C.mask_email("x", digits=6), "a@b.hu") == "5e1e74@masked.com"


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (2.25,)], "x double")
    got = [r[0] for r in df.select(F.bround("x", 0)).collect()]
    assert got == [0.0, 2.0, 2.0, 2.0]
    assert df.select(F.bround("x", 1)).collect()[3][0] == 2.2


def test_first_non_null_skips_nulls(spark):
    df = spark.createDataFrame([("o", 1, None), ("o", 2, 5.0), ("o", 3, 7.0)], "g string, line_no int, x double")
    r = df.groupBy("g").agg(C.first_non_null("x", df).alias("f")).first()
    assert r["f"] == 5.0


def test_weekday(spark):
    ts = dt.datetime(2024, 1, 1, 14)  # a Monday
    df = spark.createDataFrame([(ts,)], "t timestamp_ntz")
    r = df.select(C.weekday_name("t").alias("n"), C.weekday_no("t").alias("k")).first()
    assert (r["n"], r["k"]) == ("Monday", 1)

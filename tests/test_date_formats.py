import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from basketlens import Params
from basketlens.functions.columns import DATE_FORMATS, infer_date_format
from basketlens.operators import clean

DAYS = [dt.datetime(2023, m, d, 7 * d % 24, 3 * d) for m in (1, 7, 12) for d in (1, 5, 13, 19)]


def java(fmt, t):
    for a, b in (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S")):
        fmt = fmt.replace(a, b)
    return t.strftime(fmt)


@pytest.mark.parametrize("fmt", DATE_FORMATS)
def test_one_format_parses_as_pandas_does(spark, fmt):
    texts = [java(fmt, t) for t in DAYS] + [None, "", "soon"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.select("i", clean.parsed_date(df, "t", Params(date_format="infer")).alias("p")).orderBy("i").select("p").collect()]
    want = pd.to_datetime(pd.Series(texts), errors="coerce", format=_directives(fmt))
    assert got == [None if pd.isna(x) else x.to_pydatetime() for x in want]


def _directives(fmt):
    for a, b in (("yyyy", "%Y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S")):
        fmt = fmt.replace(a, b)
    return fmt


def test_the_most_frequent_of_mixed_formats_wins(spark):
    texts = [java("dd.MM.yyyy", t) for t in DAYS] + [java("yyyy/MM/dd HH:mm", t) for t in DAYS[:5]] + [" 24.12.2023\t"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    assert infer_date_format(df, "t") == "dd.MM.yyyy"
    got = df.select(clean.parsed_date(df, "t", Params(date_format="infer")).alias("p"))
    assert got.filter(F.col("p").isNotNull()).count() == len(DAYS) + 1


def test_ambiguous_iso_typed_and_empty_columns(spark):
    assert infer_date_format(spark.createDataFrame([("03/04/2024",), ("05/06/2024",)], "t string"), "t") == "MM/dd/yyyy"
    assert infer_date_format(spark.createDataFrame([("03/04/2024",), ("25/06/2024",)], "t string"), "t") == "dd/MM/yyyy"
    assert infer_date_format(spark.createDataFrame([("2024-03-04 10:11:12.5",)], "t string"), "t") is None
    assert infer_date_format(spark.createDataFrame([(None,)], "t string"), "t") is None
    assert infer_date_format(spark.createDataFrame([(dt.datetime(2024, 1, 1),)], "t timestamp_ntz"), "t") is None


def test_order_lines_infer_each_column(spark):
    raw = spark.createDataFrame([("1", "05.03.2024", "2023/01/02 10:20", "x", 1.0, 0.0, 0.0), ("2", "25.03.2024", None, "x", 1.0, 0.0, 0.0)],
                                "order_number string, order_date string, customer_first_order string, order_status string, line_total double, refund_amount double, discount_amount double")
    out = clean.order_lines(raw, Params(completed_status="x", date_format="infer")).orderBy("order_number").collect()
    assert [(r.year, r.month) for r in out] == [(2024, 3), (2024, 3)]
    assert out[0].customer_first_order == dt.datetime(2023, 1, 2, 10, 20)

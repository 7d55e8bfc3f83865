"""Monthly sketches: merging, empties, nulls and the stated error."""

from decimal import Decimal

from basketlens.operators import audience, discounts, sketches

SCHEMA = "order_number long, year int, month int, gender string, line_revenue decimal(28,6), discount_amount decimal(28,6)"


def frame(spark, rows):
    return spark.createDataFrame([(*r[:4], *[None if x is None else Decimal(x) for x in r[4:]]) for r in rows], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def spread(n):
    """Orders of three lines each: two in one month, one in the next."""
    return [(i, 2000 + i % 3, 1 + (i + k // 2) % 12, ["f", "m", None][i % 3 if k else 0], "2.5", "1" if i % 2 else "0") for i in range(n) for k in range(3)]


def test_small_counts_are_exact_and_orders_over_months_count_once(spark):
    every = frame(spark, [*spread(90), (None, 2000, 1, "f", "1", "1"), (7, None, None, "f", "1", "1"), (8, 2001, 1, "m", None, None)])
    parts = sketches.monthly_partials(every)
    assert rows(sketches.discount_summary(parts)) == rows(discounts.discount_summary(every))
    assert rows(sketches.gender_summary(parts)) == rows(audience.gender_summary(every))


def test_partials_merge_like_one_table(spark):
    all_rows = spread(3000)
    whole = sketches.monthly_partials(frame(spark, all_rows))
    merged = sketches.merge_partials(sketches.monthly_partials(frame(spark, all_rows[:5000])), sketches.monthly_partials(frame(spark, all_rows[5000:])))
    exact = audience.gender_summary(frame(spark, all_rows))
    for parts in (whole, merged):
        out = sketches.against_exact(sketches.gender_summary(parts), exact, "gender", "orders").collect()
        assert len(out) == 2 and all(r.within for r in out)
    assert [r[:1] for r in rows(sketches.discount_summary(merged))] == [r[:1] for r in rows(discounts.discount_summary(frame(spark, all_rows)))]


def test_stated_error_holds_on_many_orders(spark):
    n = 200_000
    every = spark.range(n).selectExpr("id as order_number", "cast(2000 + id % 2 as int) as year", "cast(1 + id % 12 as int) as month", "'f' as gender",
                                      "cast(1 as decimal(28,6)) as line_revenue", "cast(1 as decimal(28,6)) as discount_amount")
    out = {r.year: r.discounted_orders for r in sketches.discount_summary(sketches.monthly_partials(every)).collect()}
    assert all(abs(x - n / 2) <= sketches.relative_error() * n / 2 for x in out.values()) and set(out) == {2000, 2001}


def test_empty(spark):
    parts = sketches.monthly_partials(frame(spark, []))
    assert rows(sketches.discount_summary(parts)) == [] and rows(sketches.gender_summary(sketches.merge_partials(parts, parts))) == []

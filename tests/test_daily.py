import datetime as dt

import pytest

from basketlens import Params
from basketlens.operators import daily, inventory
from test_grains import lines, same  # noqa: F401  (the fixture of lines with nulls and ties)


@pytest.mark.parametrize("clock", [dt.datetime(2024, 6, 1), dt.datetime(2023, 2, 1), dt.datetime(2024, 1, 15, 13, 30), dt.datetime(2022, 1, 1)])
def test_any_clock_from_stored_days(spark, lines, tmpdir_run, clock):  # noqa: F811
    p = Params(as_of=clock)
    daily.stage_item_days(daily.item_days(lines), tmpdir_run + "/days")
    days = daily.read_item_days(spark, tmpdir_run + "/days")
    got = daily.item_sales(days, p, lines)
    same(got, inventory.item_sales(lines, p))
    if clock.hour == 0:                                  # the lines are not read again
        plan = daily.item_sales(days, p)._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" not in plan and "PartitionFilters: [isnotnull(year" in plan


def test_days_appended_in_parts(spark, lines, tmpdir_run):  # noqa: F811
    p = Params(as_of=dt.datetime(2024, 6, 1))
    for k in range(3):
        daily.stage_item_days(daily.item_days(lines.filter(f"line_no % 3 = {k}")), tmpdir_run + "/days", "append")
    same(daily.item_sales(daily.read_item_days(spark, tmpdir_run + "/days"), p), inventory.item_sales(lines, p))


def test_a_clock_is_needed(spark, lines):  # noqa: F811
    days = daily.item_days(lines)
    with pytest.raises(ValueError):
        daily.item_sales(days, Params())
    with pytest.raises(ValueError):
        daily.item_sales(days, Params(as_of=dt.datetime(2024, 6, 1, 12)))

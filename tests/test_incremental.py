"""Incremental staging: re-runs change nothing, a late file changes only its years, broken runs are taken up again."""

import os
import shutil

import pytest

from basketlens.operators import clean, revenue
from basketlens.schema import Params
from basketlens.sources.incremental import staged_lines, take_files, taken_files
from basketlens.sources.readers import read_order_lines

P = Params(completed_status="F")
HEAD = "Order Number,Order Date,Order Status,Order Line Total (include tax),Order Refund Amount,Item Discount Amount\n"


def export(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
        f.write(HEAD + "".join(",".join("" if v is None else str(v) for v in r) + "\n" for r in rows))


def files(folder):
    return {os.path.join(a, f): os.stat(os.path.join(a, f)).st_mtime_ns for a, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def totals(df):
    return sorted((tuple(r) for r in revenue.yearly_totals(revenue.monthly_revenue(clean.order_totals(df))).collect()), key=repr)


def fresh(spark, folder):
    return clean.order_lines(read_order_lines(spark, folder, "csv"), P)


def rows(df):
    return sorted((tuple(r[c] for c in ("order_number", "year", "line_revenue")) for r in df.collect()), key=repr)


@pytest.fixture()
def shop(spark, tmpdir_run):
    source, folder = f"{tmpdir_run}/exports of the shop", f"{tmpdir_run}/staged"
    export(source, "a.csv", [(1, "2022-01-02", "F", 10, 1, 0), (1, "2022-01-02", "F", 5, 1, 0), (2, "2023-05-06", "F", 7, 0, 2), (3, "2023-01-01", "O", 9, 0, 0)])
    export(source, "b.csv", [(4, "2024-01-02", "F", 3, 0, 0), (5, None, "F", 4, 0, 0)])
    assert take_files(spark, source, folder, P, "csv") == [None, 2022, 2023, 2024]
    return source, folder


def test_taking_again_changes_nothing(spark, shop):
    source, folder = shop
    before = files(folder)
    assert take_files(spark, source, folder, P, "csv") == [] and files(folder) == before
    assert rows(staged_lines(spark, folder)) == rows(fresh(spark, source)) and totals(staged_lines(spark, folder)) == totals(fresh(spark, source))


def test_a_late_file_changes_only_its_years(spark, shop):
    source, folder = shop
    before = files(folder)
    export(source, "late.csv", [(6, "2023-07-08", "F", 11, 0, 0), (1, "2023-09-09", "O", 1, 0, 0)])
    assert take_files(spark, source, folder, P, "csv") == [2023]
    after = files(folder)
    changed = {f for f in before.keys() ^ after.keys() if "/lines/" in f} | {f for f in before.keys() & after.keys() if before[f] != after[f]}
    assert changed and all("year=2023" in f for f in changed)
    assert rows(staged_lines(spark, folder)) == rows(fresh(spark, source)) and totals(staged_lines(spark, folder)) == totals(fresh(spark, source))
    assert taken_files(spark, folder).count() == 3


def test_a_run_that_died_before_its_list_counts_lines_once(spark, shop, tmpdir_run):
    source, folder = shop
    shutil.copytree(f"{folder}/taken", f"{tmpdir_run}/earlier/taken")
    shutil.copytree(f"{folder}/lines", f"{tmpdir_run}/earlier/lines")
    export(source, "c.csv", [(7, "2022-07-08", "F", 11, 0, 0), (7, "2022-07-08", "F", 11, 0, 0)])
    take_files(spark, source, folder, P, "csv")
    broken = f"{tmpdir_run}/broken"                         # the lines of the new run with the list of the one before
    shutil.copytree(f"{folder}/lines", f"{broken}/lines")
    shutil.copytree(f"{tmpdir_run}/earlier/taken", f"{broken}/taken")
    spark.catalog.clearCache()
    assert take_files(spark, source, broken, P, "csv") == [2022]
    assert rows(staged_lines(spark, broken)) == rows(fresh(spark, source))


def test_files_without_lines_undated_files_and_changed_files(spark, shop):
    source, folder = shop
    export(source, "none.csv", [(8, "2022-01-01", "O", 1, 0, 0)])
    assert take_files(spark, source, folder, P, "csv") == [] and taken_files(spark, folder).count() == 3
    export(source, "undated.csv", [(9, None, "F", 1, 0, 0)])
    assert take_files(spark, source, folder, P, "csv") == [None]
    assert rows(staged_lines(spark, folder)) == rows(fresh(spark, source))
    export(source, "a.csv", [(1, "2022-01-02", "F", 10, 1, 0)])
    with pytest.raises(ValueError, match="changed after"):
        take_files(spark, source, folder, P, "csv")


def test_other_columns_are_refused(spark, shop, tmpdir_run):
    source, folder = shop
    path = f"{tmpdir_run}/other.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write(HEAD.strip() + ",City (Billing)\n1,2022-01-02,F,1,0,0,Pécs\n")
    with pytest.raises(ValueError, match="city"):
        take_files(spark, path, folder, P, "csv")
    assert rows(staged_lines(spark, folder)) == rows(fresh(spark, source))

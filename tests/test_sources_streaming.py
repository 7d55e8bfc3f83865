import csv
import os

from basketlens import Params
from basketlens.operators import clean, revenue
from basketlens.sources import readers
from basketlens.sources.readers import name_list
from basketlens.streaming.anonymise import anonymised_stream, write_stream

HEAD = ["Order Number", "Order Date", "Order Status", "Order Line Total (include tax)",
        "Order Refund Amount", "Item Discount Amount", "Email (Billing)", "First Name (Billing)",
        "Last Name (Billing)", "Phone (Billing)", "City (Billing)"]
ROWS = [["1", "2024-01-05 10:00", "Teljesítve", "1000", "0", "100", "a@b.hu", "Győző", "Nagy", "+36", "Pécs"],
        ["1", "2024-01-05 10:00", "Teljesítve", "500", "0", "0", "a@b.hu", "Győző", "Nagy", "+36", "Pécs"],
        ["2", "2024-02-05 11:00", "Teljesítve", "x", "0", "0", "c@d.hu", "Anna", "Kiss", "+36", "Győr"],
        ["3", "2024-02-07 11:00", "Függőben", "700", "0", "0", "c@d.hu", "Anna", "Kiss", "+36", "Győr"]]


def write_csv(path):
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/part-0.csv", "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh)
        w.writerow(HEAD)
        w.writerows(ROWS)


def test_csv_export_to_monthly_revenue(spark, tmpdir_run):
    src = f"{tmpdir_run}/export"
    write_csv(src)
    raw = readers.read_order_lines(spark, src, fmt="csv")
    assert "order_number" in raw.columns and "Order Number" not in raw.columns
    monthly = revenue.monthly_revenue(clean.order_totals(clean.order_lines(raw, Params())))
    got = sorted((r["year"], r["month"], float(r["net_revenue"])) for r in monthly.collect())
    assert got == [(2024, 1, 1400.0), (2024, 2, 0.0)]


def test_parquet_roundtrip_with_line_ordinal(spark, tmpdir_run):
    src = f"{tmpdir_run}/export"
    write_csv(src)
    raw = readers.read_order_lines(spark, src, fmt="csv")
    out = f"{tmpdir_run}/pq"
    readers.write_table(raw, out)
    back = readers.read_order_lines(spark, out)
    assert "line_no" in back.columns and back.count() == len(ROWS)


def test_city_county_reader(spark, tmpdir_run):
    path = f"{tmpdir_run}/cities.csv"
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("city,county\nPécs,Baranya\nGyőr,Győr-Moson-Sopron\n")
    assert readers.read_city_county(spark, path).count() == 2


def test_streaming_anonymiser(spark, tmpdir_run):
    src = f"{tmpdir_run}/incoming"
    write_csv(src)
    male = name_list(spark.createDataFrame([("Győző",)], "value string"))
    female = name_list(spark.createDataFrame([("Anna",)], "value string"))
    schema = ", ".join(f"`{h}` string" for h in HEAD)
    stream = anonymised_stream(spark, src, schema, male, female, Params(), fmt="csv")
    assert stream.isStreaming
    q = write_stream(stream, f"{tmpdir_run}/out", f"{tmpdir_run}/chk")
    q.awaitTermination(120)
    out = spark.read.parquet(f"{tmpdir_run}/out")
    rows = {r["order_number"]: r for r in out.collect()}
    assert len(out.collect()) == len(ROWS)
    assert "first_name" not in out.columns and "phone_billing" not in out.columns
    assert rows["1"]["gender"] == "Férfi" and rows["2"]["gender"] == "Nő"
    assert rows["1"]["email"] == "5e1e7445a5@masked.com"


def test_anonymise_file_and_all_reports(spark, tmpdir_run):
    from basketlens.plans.reports import all_reports, anonymise_file
    src = f"{tmpdir_run}/export"
    write_csv(src)
    with open(f"{tmpdir_run}/m.txt", "w", encoding="utf-8") as fh:
        fh.write("Győző\n")
    with open(f"{tmpdir_run}/f.txt", "w", encoding="utf-8") as fh:
        fh.write("Anna\n")
    out = anonymise_file(spark, src, f"{tmpdir_run}/m.txt", f"{tmpdir_run}/f.txt", fmt="csv")
    assert out.endswith("export_anonymized")
    back = spark.read.csv(out, header=True)
    assert back.count() == len(ROWS) and "First Name (Billing)" not in back.columns
    assert {r["gender"] for r in back.collect()} == {"Férfi", "Nő"}
    lines = clean.order_lines(readers.read_order_lines(spark, src, fmt="csv"), Params())
    reps = all_reports(lines, segments_too=False)
    try:
        got = reps["R1_monthly_revenue"].outputs["monthly_revenue"].collect()
        assert [(r["year"], r["month"]) for r in got] == [(2024, 1), (2024, 2)]
        assert reps["R7_discounts"].outputs["discount_summary"].count() == 1
    finally:
        for r in reps.values():
            r.release()


def test_cli_report_and_anonymise(spark, tmpdir_run):
    from basketlens.__main__ import main
    src = f"{tmpdir_run}/export"
    write_csv(src)
    out = f"{tmpdir_run}/reports"
    assert main(["report", src, "--out", out, "--format", "csv", "--as-of", "2024-06-01", "--no-segments"]) == 0
    got = spark.read.parquet(f"{out}/R1_monthly_revenue/monthly_revenue").collect()
    assert sorted((r["year"], r["month"]) for r in got) == [(2024, 1), (2024, 2)]
    for name, text in (("m.txt", "Győző\n"), ("f.txt", "Anna\n")):
        with open(f"{tmpdir_run}/{name}", "w", encoding="utf-8") as fh:
            fh.write(text)
    assert main(["anonymise", src, "--male", f"{tmpdir_run}/m.txt", "--female", f"{tmpdir_run}/f.txt",
                 "--format", "csv", "--out", f"{tmpdir_run}/anon"]) == 0
    assert spark.read.csv(f"{tmpdir_run}/anon", header=True).count() == len(ROWS)


def test_streaming_restart_processes_new_files_once(spark, tmpdir_run):
    src = f"{tmpdir_run}/incoming"
    write_csv(src)
    male = name_list(spark.createDataFrame([("Győző",)], "value string"))
    female = name_list(spark.createDataFrame([("Anna",)], "value string"))
    schema = ", ".join(f"`{h}` string" for h in HEAD)
    out, chk = f"{tmpdir_run}/out", f"{tmpdir_run}/chk"

    def run_once():
        q = write_stream(anonymised_stream(spark, src, schema, male, female, Params(), fmt="csv"), out, chk)
        q.awaitTermination(120)

    run_once()
    with open(f"{src}/part-1.csv", "w", newline="", encoding="utf-8") as fh:
        w = csv.writer(fh)
        w.writerow(HEAD)
        w.writerow(["9", "2024-03-01 09:00", "Teljesítve", "10", "0", "0", "z@z.hu", "Anna", "Kiss", "+36", "Pécs"])
    run_once()                      # restart from the checkpoint: only the new file is read
    run_once()                      # nothing new: nothing appended
    got = sorted(r["order_number"] for r in spark.read.parquet(out).collect())
    assert got == sorted([r[0] for r in ROWS] + ["9"])

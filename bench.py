"""Benchmark: seconds per report (R1-R14) on $BENCH_SF_DIR, local[$BENCH_CPUS].

Protocol: one warm-up pass, then the median of $BENCH_RUNS passes; each
report's DataFrames are written to the ``noop`` sink (full execution, no
output I/O). Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
ONLY = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]   # e.g. "R1,R6"


def session():
    from pyspark.sql import SparkSession
    builder = (SparkSession.builder.master(f"local[{CPUS}]").appName("basketlens-bench")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.shuffle.partitions", os.environ.get("BENCH_SHUFFLE", str(max(CPUS * 2, 8))))
               .config("spark.driver.memory", "16g")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    from pyspark import SparkConf
    if not SparkConf().contains("spark.checkpoint.dir"):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-ckpt-", dir="/tmp"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def calibration_seconds(n: int = 5_000_000) -> float:
    """Host-speed reference: a fixed pure-Python loop (compare runs by this)."""
    t0 = time.perf_counter()
    x = 0
    for i in range(n):
        x += i
    return round(time.perf_counter() - t0, 3)


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    from basketlens.plans import bundle as B
    from basketlens.plans import catalog as C
    from basketlens.sources import tables

    spark = session()

    from basketlens.plans.reports import bound_reports

    def report_runner(make):
        def run():
            rep = make()
            try:
                for df in rep.outputs.values():
                    run_noop(df)
            finally:
                rep.release()
        return run

    def run_bundle():
        lines = C.lines(spark, SF_DIR, "city", "category_path", "item_id", "item_name", "quantity",
                        "stock_quantity", "email", "customer_total_orders", "customer_total_spent",
                        "customer_first_order", "customer_last_order")
        b = B.report_bundle(lines, tables.city_county_table(spark, SF_DIR), C.P)
        try:
            for k, df in b.items():
                if not k.startswith("_"):
                    run_noop(df)
        finally:
            B.release(b)

    runners = {name: report_runner(make) for name, make in bound_reports(spark, SF_DIR).items()}
    runners["R13_report_bundle"] = run_bundle
    order = sorted(runners, key=lambda k: int(k.split("_")[0][1:]))
    if ONLY:
        order = [k for k in order if k.split("_")[0] in ONLY]

    times: dict[str, list[float]] = {k: [] for k in order}
    for rep in range(RUNS + 1):
        for name in order:
            t0 = time.perf_counter()
            runners[name]()
            if rep > 0:
                times[name].append(time.perf_counter() - t0)
    med = {k: round(statistics.median(v), 3) for k, v in times.items()}
    sf = SF_DIR.rstrip("/").split("sf")[-1]
    try:
        sf_val = float(sf)
    except ValueError:
        sf_val = sf
    print(json.dumps({"metric": "sum_of_report_medians", "value": round(sum(med.values()), 3),
                      "unit": "sec", "queries": med, "sf": sf_val, "cpus": CPUS, "runs": RUNS,
                      "host_calibration_sec": calibration_seconds()}))
    spark.stop()


if __name__ == "__main__":
    main()

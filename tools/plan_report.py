"""Summarise the physical plan of every catalog query into PLANS.md.

Two settings: the session defaults (AQE on, planner broadcasts small
tables) and a scale emulation where automatic broadcasts are off, so the
only broadcasts left are the ones the code proves small (year lists,
checked lookups). Usage: python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SKIP = {"segment_summary_active", "segment_summary_all", "segment_assignments"}  # fit k-means when built


def summary(plan: str) -> tuple[str, str, str, str]:
    scans = re.findall(r"FileScan parquet [^\[]*\[[^\]]*\][^\n]*?Location: \w+\(\d+ paths\)\[[^\]]*?/(\w+)\.parquet", plan)
    scans = scans or re.findall(r"/(\w+)\.parquet\]", plan)
    exchanges = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)]
    exchanges = [e.replace("_groupingexpression", "expr") for e in exchanges]
    joins = []
    for kind in ("BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin"):
        n = plan.count(kind)
        if n:
            joins.append(f"{n} {kind.replace('Join', '')}")
    pushed = set()
    for p in re.findall(r"PushedFilters: \[([^\]\n]*)", plan):
        for f in re.findall(r"(?:EqualTo|GreaterThanOrEqual|GreaterThan|LessThan|In)\([^()]*\)", p):
            pushed.add(re.sub(r"#\d+", "", f))
    pushed = sorted(pushed)
    return (", ".join(sorted(set(scans))) + f" ({len(scans)})", "; ".join(exchanges) or "-",
            ", ".join(joins) or "-", "; ".join(pushed) or "-")


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="plan-ckpt-", dir="/tmp"))
             .config("spark.sql.shuffle.partitions", "16").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from basketlens.plans.catalog import QUERIES
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` on `{sf}`. *Scans*: parquet tables read (count of file scans, subqueries")
    print("included). *Shuffles*: hash-exchange keys. *Pushed*: comparison filters pushed into a Parquet scan.\n")
    for title, conf in (("Session defaults (AQE on, planner broadcasts tables under 10 MB)", "10485760"),
                        ("Scale emulation (automatic broadcast off; only size-proven broadcasts remain)", "-1")):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", conf)
        print(f"## {title}\n")
        print("| query | scans | shuffles | joins | pushed |")
        print("| --- | --- | --- | --- | --- |")
        for name in sorted(QUERIES):
            if name in SKIP:
                continue
            df = QUERIES[name](spark, sf)
            buf = io.StringIO()
            with contextlib.redirect_stdout(buf):
                df.explain()
            plan = buf.getvalue()
            s = summary(plan)
            print(f"| {name} | {s[0]} | {s[1]} | {s[2]} | {s[3]} |")
        print()
    print("The k-means queries are omitted: they run jobs while being built (fitting); their feature plans are")
    print("`customer_features_active` / `customer_features_all`.")


if __name__ == "__main__":
    main(sys.argv[1:])

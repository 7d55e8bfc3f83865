"""Command line: the two workflows of the reference as Spark applications.

    python -m basketlens anonymise EXPORT --male M.txt --female F.txt [--format csv]
    python -m basketlens report EXPORT --out DIR [--cities C.csv] [--format csv] [--status F]

``anonymise`` writes ``<EXPORT stem>_anonymized`` next to the input.
``report`` writes every report table as Parquet under ``DIR/<report>/<table>``.
The session comes from ``spark-submit``/the environment; only here is one created.
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys

from basketlens.schema import Params


def _session(app: str):
    from pyspark.sql import SparkSession
    return SparkSession.builder.appName(app).getOrCreate()


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="basketlens")
    sub = ap.add_subparsers(dest="cmd", required=True)
    an = sub.add_parser("anonymise", help="infer gender, drop personal columns, mask e-mail")
    an.add_argument("export")
    an.add_argument("--male", required=True)
    an.add_argument("--female", required=True)
    an.add_argument("--format", default="parquet")
    an.add_argument("--out")
    rp = sub.add_parser("report", help="write every report table")
    rp.add_argument("export")
    rp.add_argument("--out", required=True)
    rp.add_argument("--cities")
    rp.add_argument("--format", default="parquet")
    rp.add_argument("--status", help="order status that counts as completed")
    rp.add_argument("--as-of", help="reference clock, e.g. 2024-06-01 (default: now)")
    rp.add_argument("--no-segments", action="store_true")
    args = ap.parse_args(argv)

    spark = _session(f"basketlens-{args.cmd}")
    if args.cmd == "anonymise":
        from basketlens.plans.reports import anonymise_file
        print(anonymise_file(spark, args.export, args.male, args.female, fmt=args.format, out_path=args.out))
        return 0

    from basketlens.operators import clean
    from basketlens.plans.reports import all_reports
    from basketlens.sources.readers import read_city_county, read_order_lines, write_table
    params = Params()
    if args.status:
        params = params.with_(completed_status=args.status)
    if args.as_of:
        params = params.with_(as_of=dt.datetime.fromisoformat(args.as_of))
    lines = clean.order_lines(read_order_lines(spark, args.export, fmt=args.format), params)
    cities = read_city_county(spark, args.cities) if args.cities else None
    for name, rep in all_reports(lines, cities, params, segments_too=not args.no_segments).items():
        try:
            for table, df in rep.outputs.items():
                write_table(df, f"{args.out.rstrip('/')}/{name}/{table}")
        finally:
            rep.release()
    print(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())

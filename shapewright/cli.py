"""shapewright scan PATH, shapewright check PATH --against BASELINE. Exit: 0; 1 if a checked file is broken; 2 if the baseline can't be used."""

from __future__ import annotations

import argparse
import json
import sys

from shapewright import __version__, report


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="shapewright", description=__doc__)
    top.add_argument("--version", action="version", version=f"shapewright {__version__}")
    sub = top.add_subparsers(dest="command", required=True)
    for name, what in (("scan", "describe the structure of a fileset"), ("check", "hold a fileset against a baseline")):
        p = sub.add_parser(name, help=what)
        p.add_argument("path", help="a folder, a glob, or a file")
        p.add_argument("--json", action="store_true", help="print the result as JSON")
        p.add_argument("--no-color", action="store_true")
        p.add_argument("--file-ceiling", type=int, default=10_000)
        p.add_argument("--quote-aware", action="store_true", help="count fields by CSV rules, not delimiters")
        p.add_argument("--leading-zeros-as-text", action="store_true")
        if name == "check":
            p.add_argument("--against", required=True, help="flat schema, DDL, earlier result, or golden file")
            p.add_argument("--align", choices=("name", "position"), default="name")
            p.add_argument("--extra", choices=("strict", "open"), default="strict")
            p.add_argument("--carry-scan-findings", action="store_true", help="keep what the scan found beside the differences")
    return top


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("shapewright").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    from shapewright.operators import baseline
    from shapewright.plans.scan import check, scan
    from shapewright.sources.listing import Limits

    spark = spark or session()
    limits, options = Limits(file_count=args.file_ceiling), {"quote_aware": args.quote_aware, "leading_zeros_as_text": args.leading_zeros_as_text}
    colour = sys.stdout.isatty() and not args.no_color
    if args.command == "scan":
        result = scan(spark, args.path, limits, **options).to_dict()
        print(json.dumps(result, indent=2, ensure_ascii=False) if args.json else report.of_scan(result, colour))
        return 0
    try:
        against = baseline.load(spark, args.against)
    except ValueError as e:
        print(f"baseline: {e}", file=sys.stderr)
        return 2
    result = check(spark, args.path, against, args.align, args.extra, limits, args.carry_scan_findings, **options).to_dict()
    print(json.dumps(result, indent=2, ensure_ascii=False) if args.json else report.of_check(result, colour))
    return int(result["has_errors"])

"""Run one operator over a star and write its result.

    python -m basketry rv01_monthly_trend --star /data/star --format csv --out /data/out/rv01
    python -m basketry --list
"""

from __future__ import annotations

import argparse
import sys

from basketry.registry import OPERATORS, run_operator
from basketry.session import build_session
from basketry.sources import read_star, write_result


def main(argv=None) -> int:
    parser = argparse.ArgumentParser(prog="basketry")
    parser.add_argument("query", nargs="?", help="operator name (see --list)")
    parser.add_argument("--star", help="directory with the eight star tables")
    parser.add_argument("--format", default="parquet", choices=("parquet", "csv"), help="star file format")
    parser.add_argument("--blank-category", default="keep", choices=("keep", "null"))
    parser.add_argument("--check-keys", action="store_true", help="fail if a primary key is null or repeats")
    parser.add_argument("--out", help="result path (default: print)")
    parser.add_argument("--out-format", default="parquet", choices=("parquet", "csv"))
    parser.add_argument("--master", default=None)
    parser.add_argument("--list", action="store_true")
    args = parser.parse_args(argv)
    if args.list or not args.query:
        print("\n".join(OPERATORS))
        return 0
    if not args.star:
        parser.error("--star is required")
    spark = build_session(args.master)
    result = run_operator(args.query, read_star(spark, args.star, args.format, args.blank_category, check_keys=args.check_keys))
    if args.out:
        write_result(result, args.out, fmt=args.out_format)
    else:
        result.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())

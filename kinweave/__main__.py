"""python -m kinweave validate: checks result files and tells by its exit status whether they may be handed in."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.linkage import validate
from .sources import tsv


def main(argv: list[str] | None = None) -> int:
    """0 if there are no errors, else 1; errors and warnings are printed."""
    parser = argparse.ArgumentParser(prog="kinweave", description="Record linkage tools.")
    check = parser.add_subparsers(dest="command", required=True).add_parser("validate", help="check result files")
    check.add_argument("--matching", "-m", required=True, help="matching_results.tsv")
    check.add_argument("--candidate", "-c", help="candidate_pairs.tsv")
    check.add_argument("--source1", "-s", required=True, help="the file whose entities must each have a row")
    check.add_argument("--targets", "-t", nargs="*", help="files of the other sources, to check that ids exist")
    check.add_argument("--strict", action="store_true", help="matches outside the candidates are errors")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("kinweave validate").getOrCreate()
    try:
        targets = None
        for path in args.targets or []:
            ids = tsv.read_ids(spark, path)
            targets = ids if targets is None else targets.unionByName(ids)
        errors, warnings = validate(spark, args.matching, args.candidate, tsv.read_ids(spark, args.source1), targets, args.strict)
    except Exception as e:  # an unreadable source is a failure of the check, told as such
        errors, warnings = [f"cannot read a source: {type(e).__name__}"], []
    for x in warnings:
        print(f"WARNING: {x}")
    for i, x in enumerate(errors, 1):
        print(f"{i}. {x}")
    print(f"FAIL: {len(errors)} errors" if errors else "PASS")
    return 1 if errors else 0


if __name__ == "__main__":
    sys.exit(main())

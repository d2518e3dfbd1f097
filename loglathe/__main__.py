"""python -m loglathe classify|parse|stats: over folders or files of JSONL that Spark reads.

Exit status: 0; 1 where a threshold isn't met or something went wrong; 2 for wrong arguments.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _arguments(argv: list[str] | None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="loglathe")
    commands = top.add_subparsers(dest="command", required=True)
    for name, told in (("classify", "label lines and records: one output for each input, then a marker"), ("parse", "records of lines, normalised and not labelled, as JSONL in the order of the lines")):
        one = commands.add_parser(name, help=told)
        one.add_argument("input")
        one.add_argument("output")
        one.add_argument("--domain", choices=("core_api", "llm", "agentic", "cv"))
    commands.choices["classify"].add_argument("--no-validation", action="store_true")
    one = commands.add_parser("stats", help="parse rates by domain; fails where one is under its threshold")
    one.add_argument("input")
    one.add_argument("--format", choices=("table", "json"), default="table")
    one.add_argument("--threshold", help="llm=90,cv=75: instead of the usual ones")
    return top.parse_args(argv)


def run(spark: SparkSession, given: argparse.Namespace) -> int:
    from .operators.records import canonical_json, unclassified
    from .operators.stats import parse_thresholds
    from .plans.pipeline import Options, normalise
    from .plans.reports import report, table
    from .sources.folders import classify_folder
    from .sources.lines import raw_events, read_jsonl

    if given.command == "classify":
        classify_folder(spark, given.input, given.output, given.domain, not given.no_validation)
        return 0
    if given.command == "parse":
        rows = normalise(raw_events(read_jsonl(spark, given.input)), Options(domain=given.domain))
        lines = rows.select("_seq", canonical_json(unclassified(F.col("record"))).alias("value"))
        lines.repartitionByRange("_seq").sortWithinPartitions("_seq").select("value").write.text(given.output)
        return 0
    thresholds = parse_thresholds(given.threshold)
    found = report(read_jsonl(spark, given.input), thresholds)
    print(json.dumps(found, indent=2) if given.format == "json" else table(found))
    return 0 if found["all_thresholds_met"] else 1


def main(argv: list[str] | None = None) -> int:
    given = _arguments(argv)
    try:
        return run(SparkSession.builder.appName("loglathe").getOrCreate(), given)
    except Exception as e:  # told in a line; the status says the rest
        print(f"ERROR: {str(e).splitlines()[0] if str(e) else type(e).__name__}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())

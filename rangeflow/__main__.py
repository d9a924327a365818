"""Command line: ``python -m rangeflow list``, ``run NAME SF_DIR [--out PATH] [--rows N]``, ``explain NAME SF_DIR``, ``inspect ROOT``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import catalog
from .sources import recordings


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rangeflow")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list", help="names of all queries")
    run = verbs.add_parser("run", help="run a query and show or write its rows")
    explain = verbs.add_parser("explain", help="show a query's plan")
    for v in (run, explain):
        v.add_argument("name", choices=sorted(catalog.QUERIES), metavar="NAME")
        v.add_argument("sf_dir")
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    run.add_argument("--rows", type=int, default=20, help="rows to show")
    look = verbs.add_parser("inspect", help="what is wrong with the recordings below a folder")
    look.add_argument("root")
    a = parser.parse_args(argv)
    if a.verb == "list":
        print("\n".join(sorted(catalog.QUERIES)))
        return 0
    spark = SparkSession.builder.appName("rangeflow").getOrCreate()
    if a.verb == "inspect":
        found = recordings.inspect(recordings.topic_counts(recordings.read_messages(spark, a.root)), recordings.expected_counts(spark, a.root))
        found.orderBy("topic").show(truncate=False)
        return 3 if found.where("problem is not null").count() else 0
    df = catalog.QUERIES[a.name](spark, a.sf_dir)
    if a.verb == "explain":
        df.explain("formatted")
    elif a.out:
        df.write.mode("errorifexists").parquet(a.out)
    else:
        df.show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

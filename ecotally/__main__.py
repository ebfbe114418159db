"""Command line: ``python -m ecotally batch --activity-table A --entity-table E
--output-path OUT [--publish-to P] [--as-of YYYY-MM-DD] [--append]``.

The same arguments as the batch job it replaces: where the activity and
entity documents are (catalog table names or paths) and the folder the dated
snapshots go to.  Without ``--publish-to`` only the snapshot is made.  Runs on the session ``spark-submit`` provides.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .plans.batch import run_batch
from .session import release_scratch
from .sources.documents import read_activity, read_entity


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="python -m ecotally")
    sub = parser.add_subparsers(dest="command", required=True)
    batch = sub.add_parser("batch", help="snapshot the joined inventory and build the report")
    batch.add_argument("--activity-table", required=True, help="catalog table or path")
    batch.add_argument("--entity-table", required=True, help="catalog table or path")
    batch.add_argument("--output-path", required=True, help="folder of the dated snapshots")
    batch.add_argument("--format", default=None, help="file format of path sources (json, parquet)")
    batch.add_argument("--activity-schema", default=None, help="DDL of the activity documents, instead of inference")
    batch.add_argument("--entity-schema", default=None, help="DDL of the entity documents, instead of inference")
    batch.add_argument("--read-once", action="store_true", help="read JSON documents once, also without a schema")
    batch.add_argument("--publish-to", default=None, help="publish the report here (a folder; created, then refreshed)")
    batch.add_argument("--as-of", default=None, help="run date YYYY-MM-DD (default: today, UTC)")
    batch.add_argument("--keep-commits", type=int, default=None, help="delete what only older commits of the published report list")
    batch.add_argument("--append", action="store_true", help="add to a same-day snapshot")
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("ecotally-batch").getOrCreate()
    result = run_batch(
        spark,
        read_activity(spark, args.activity_table, args.format, args.activity_schema, args.read_once),
        read_entity(spark, args.entity_table, args.format, args.entity_schema, args.read_once),
        args.output_path,
        as_of=args.as_of,
        publish_to=args.publish_to,
        snapshot_mode="append" if args.append else "overwrite",
        build_report=args.publish_to is not None,
        keep_commits=args.keep_commits,
    )
    release_scratch(spark)
    print(f"snapshot {result.run_date} written to {result.snapshot_path}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

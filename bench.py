"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPS (default 3; the median is reported per query).

Every query is executed in full with the ``noop`` sink (all stages run, no
rows are collected to the driver).  One untimed pass of every query at the
same scale loads classes and JIT-compiles before timing.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from ecotally.operators.rollup import rollup_report, rollup_totals  # noqa: E402
from ecotally.plans.catalog import QUERIES, latest_view  # noqa: E402
from ecotally.session import build_session, release_scratch  # noqa: E402

HEADLINE = [
    "rollup_report",
    "rollup_report_entity",
    "batch_report",
    "rollup_contributions",
    "rollup_by_level",
    "entity_totals",
    "activity_entity_join",
    "snapshot_roundtrip",
    "latest_partition",
    "rls_tenant",
    "grant_upsert",
    "incremental_refresh",
    "scan_activity",
]


def deep(v):
    """V with one row an entity, re-hung on chains of 40 entities (several rows
    would multiply to totals beyond their type)."""
    v = v.filter("activityid = 'A'")
    key = F.col("entityid").cast("int")
    up = F.when((key / 4).cast("int") % 40 == 0, None).otherwise(key - 4)
    return v.withColumn("parententityid", up.cast("string"))


def hot(v):
    """V with a third of its rows on one entity."""
    return v.withColumn("entityid", F.when(F.col("activityid") == "A", "4").otherwise(F.col("entityid"))).withColumn(
        "tenantid", F.when(F.col("activityid") == "A", "t0").otherwise(F.col("tenantid"))
    ).withColumn("parententityid", F.when(F.col("entityid") == "4", "0").otherwise(F.col("parententityid")))


#: The roll-up alone, on a snapshot that is already written.
ON_SNAPSHOT = {
    "snapshot_rollup_report": lambda v: rollup_report(v),
    "snapshot_rollup_totals": lambda v: rollup_totals(v),
    "snapshot_rollup_deep": lambda v: rollup_totals(deep(v)),
    "snapshot_rollup_hot": lambda v: rollup_totals(hot(v)),
}


def run_once(spark, name: str, sf_dir: str, v=None) -> float:
    t = time.perf_counter()
    df = ON_SNAPSHOT[name](v) if name in ON_SNAPSHOT else QUERIES[name](spark, sf_dir)
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = build_session("ecotally-bench", extra={"spark.ui.showConsoleProgress": "false"})
    # one untimed pass at the measured scale: class loading and JIT happen
    # here, not inside the first query's timings
    v = latest_view(spark, sf_dir)
    for name in [*HEADLINE, *ON_SNAPSHOT]:
        run_once(spark, name, sf_dir, v)
    times: dict[str, float] = {}
    for name in [*HEADLINE, *ON_SNAPSHOT]:
        samples = [run_once(spark, name, sf_dir, v) for _ in range(reps)]
        times[name] = round(statistics.median(samples), 3)
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times[n] for n in HEADLINE), 3),
                "unit": "sec",
                "queries": {n: times[n] for n in HEADLINE},
                "on_snapshot": {n: times[n] for n in ON_SNAPSHOT},
                "sf": sf,
                "cpus": int(os.environ.get("BENCH_CPUS", "8")),
                "reps": reps,
            }
        )
    )
    release_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()

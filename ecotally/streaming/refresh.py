"""New snapshot files -> rebuilt report -> incremental refresh of the dataset.

A file-stream source over the snapshot folder notices new snapshot files (the
source keeps its own log of seen files in ``checkpoint_location``); each
micro-batch that brings rows rebuilds the report over the newest snapshot
partition and re-imports the lookback window of the published dataset.  The
stream's progress and the dataset's day folders are both on shared storage,
so a restarted driver resumes where it stopped and a repeated batch rewrites
the same folders (idempotent).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.latest import latest_snapshot
from ..operators.refresh import publish_or_refresh
from ..operators.rollup import rollup_report
from ..operators.shape import cast_date
from ..sources.snapshot import read_snapshots


def _default_report(latest: DataFrame) -> DataFrame:
    return cast_date(rollup_report(latest, sort=False), "date", "yyy/MM/dd")


def snapshot_refresh(
    spark: SparkSession,
    snapshot_path: str,
    target: str,
    checkpoint_location: str,
    *,
    build_report: Callable[[DataFrame], DataFrame] = _default_report,
    column: str = "date",
    days: int = 1,
    available_now: bool = True,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Start the refresh stream (``available_now``: process what is there, stop)."""
    schema = read_snapshots(spark, snapshot_path).schema
    source = (
        spark.readStream.schema(schema)
        .option("basePath", snapshot_path)
        .parquet(snapshot_path)
    )

    def on_batch(batch: DataFrame, _batch_id: int) -> None:
        if batch.isEmpty():  # one row probe: no new snapshot files
            return
        latest = latest_snapshot(spark, snapshot_path)
        # the report has the snapshot's own dates: look back from the newest of them
        dates = cast_date(latest.select(column), column, "yyy/MM/dd") if dict(latest.dtypes)[column] == "string" else latest
        publish_or_refresh(
            build_report(latest), target, column, as_of=dates.agg(F.max(column)).first()[0], days=days
        )

    writer = source.writeStream.foreachBatch(on_batch).option(
        "checkpointLocation", checkpoint_location
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()

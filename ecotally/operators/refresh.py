"""Lookback filter (F3) and refreshes of the published dataset (M1, M2).

Incremental refresh re-imports only the lookback window: rows of the target
older than the cut (or without a date) stay, rows of the source inside the
window replace the target's window.  The cut is ``as_of - days``, inclusive;
``as_of`` is injected (a literal or a scalar-subquery column).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.committed import (
    Commit,
    commit,
    merged_schema,
    newest_commit,
    read_committed,
    replace_all,
    write_version,
)


def _as_of(as_of) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, datetime):
        return F.lit(as_of)
    return F.to_timestamp(F.lit(str(as_of)))


def lookback_cut(as_of, days: int = 1) -> Column:
    return _as_of(as_of) - F.make_interval(days=F.lit(days))


def lookback(df: DataFrame, column: str, as_of, days: int = 1) -> DataFrame:
    """rows whose ``column`` lies in ``[as_of - days, +inf)``."""
    return df.filter(F.col(column) >= lookback_cut(as_of, days))


def incremental_refresh(
    target: DataFrame, source: DataFrame, column: str, as_of, days: int = 1
) -> DataFrame:
    """M1: target outside the window + source inside the window.

    Idempotent: refreshing twice with the same source and ``as_of`` gives the
    same rows.  On disk, write the result's window with dynamic partition
    overwrite when the dataset is partitioned by the date.
    """
    cut = lookback_cut(as_of, days)
    keep = target.filter((F.col(column) < cut) | F.col(column).isNull())
    fresh = source.filter(F.col(column) >= cut)
    return keep.unionByName(fresh)


DAY_PARTITION = "date_day"


def _by_day(report: DataFrame, column: str, day_column: str) -> DataFrame:
    """Rows with their day, a day's rows together; a large day in several parts."""
    return report.withColumn(day_column, F.to_date(F.col(column))).hint("rebalance", day_column)


def publish_by_day(
    report: DataFrame, target: str, column: str = "date", day_column: str = DAY_PARTITION
) -> None:
    """Import of a published dataset: every row, partitioned by day, as one commit."""
    replace_all(_by_day(report, column, day_column), target, [day_column])


def refresh_published(
    report: DataFrame,
    target: str,
    column: str = "date",
    as_of=None,
    days: int = 1,
    day_column: str = DAY_PARTITION,
) -> None:
    """M1 on disk: re-import the lookback window of ``target``.

    The published dataset is partitioned by day, so the window is widened to
    whole days: every row of ``report`` whose day is on or after the day of
    ``as_of - days`` is rewritten, and days of the window that have no rows any
    more go, as in ``incremental_refresh``.  Older days and the NULL-date
    folder stay, and the target is never read.

    The window's days are written as a new version, and one commit names them
    and the older days that stay: a failure at any step leaves the old dataset or
    the new one.  ``as_of`` is a time or a scalar column; take it from what the
    report is built on.  By default it is the newest ``column`` value of ``report``.
    """
    spark = report.sparkSession
    old = newest_commit(spark, target)
    if old is None:
        raise FileNotFoundError(f"no published dataset at {target}")
    if as_of is None:
        as_of = report.select(F.max(column)).scalar()
    first_day = F.to_date(lookback_cut(as_of, days))
    cut = spark.range(1).select(first_day.cast("string")).first()[0]
    if cut is None:  # no time to look back from: nothing to refresh
        return
    fresh = _by_day(report, column, day_column)
    schema = merged_schema(old.schema, fresh.schema)
    number = old.number + 1
    window = write_version(fresh.filter(F.col(day_column) >= F.lit(cut).cast("date")), target, number, [day_column])
    kept = [f for f in old.folders if (day := f.rpartition("=")[2]) < cut or not day[0].isdigit()]
    commit(spark, target, Commit(number, (*kept, *window), schema, old.partitions))


def publish_or_refresh(report: DataFrame, target: str, column: str = "date", as_of=None, days: int = 1) -> bool:
    """Create the published dataset if there is none at ``target`` (every row),
    else refresh its lookback window.  Returns whether it was created."""
    if newest_commit(report.sparkSession, target) is not None:
        refresh_published(report, target, column, as_of, days)
        return False
    publish_by_day(report, target, column)
    return True


def read_published(spark: SparkSession, target: str, day_column: str | None = DAY_PARTITION) -> DataFrame:
    """The published dataset as last committed, without its partition column."""
    rows = read_committed(spark, target)
    return rows.drop(day_column) if day_column else rows


def full_refresh(source: DataFrame, target: str, base: Commit | None | str = "newest") -> None:
    """M2: replace the published dataset with ``source`` in one commit.  Give the commit
    that ``source`` was made from as ``base`` (None: there was none):
    ``CommitConflict`` if it is no longer the newest."""
    replace_all(source, target, base=base)

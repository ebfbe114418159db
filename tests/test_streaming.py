"""Refresh stream: new snapshot files drive an incremental refresh."""
import datetime
import os
from decimal import Decimal

from pyspark.sql import functions as F

from ecotally.operators.refresh import incremental_refresh, publish_by_day, read_published, refresh_published
from ecotally.sources.snapshot import write_snapshot
from ecotally.streaming import snapshot_refresh

SCHEMA = "tenantid string, entityid string, parententityid string, activityid string, " \
         "emissioninkgco2 decimal(20,10), emissioninkgco2_forlocationbased decimal(20,10), " \
         "emissioninkgco2_formarketbased decimal(20,10), parentcontributionpercentage decimal(10,2), date string"


def snap(spark, amount):
    rows = [("t", "r", None, "a1", Decimal(amount), None, None, Decimal("0.5"), "2024/01/05"),
            ("t", "c", "r", "a2", Decimal(amount), None, None, Decimal("0.5"), "2024/01/10")]
    return spark.createDataFrame(rows, SCHEMA)


def published(spark, path):
    return {(r["entityid"], str(r["date_day"])): r["total_emissions_locationbased"]
            for r in read_published(spark, path, day_column=None).collect()}


def test_refresh_published_rewrites_only_window(spark, tmp_dir):
    target = os.path.join(tmp_dir, "pub")
    old = spark.createDataFrame([("x", datetime.datetime(2024, 1, 1), 1), ("x", datetime.datetime(2024, 1, 10), 1)],
                                "k string, date timestamp_ntz, v int")
    publish_by_day(old, target)
    new = old.withColumn("v", F.lit(2))
    refresh_published(new, target, "date", as_of=datetime.datetime(2024, 1, 10), days=1)
    got = sorted((str(r["date_day"]), r["v"]) for r in read_published(spark, target, day_column=None).collect())
    assert got == [("2024-01-01", 1), ("2024-01-10", 2)]


def test_stream_refreshes_on_new_snapshots(spark, tmp_dir):
    snaps = os.path.join(tmp_dir, "snaps")
    target = os.path.join(tmp_dir, "published")
    ckpt = os.path.join(tmp_dir, "stream-ckpt")
    write_snapshot(snap(spark, "10"), snaps, "2024-01-10")
    q = snapshot_refresh(spark, snaps, target, ckpt)
    q.awaitTermination(120)
    first = published(spark, target)
    # r: own 10 + c's 10*0.5 ; c: 10 (report over the newest snapshot)
    assert first == {("r", "2024-01-05"): Decimal("15"), ("c", "2024-01-10"): Decimal("10")}
    write_snapshot(snap(spark, "20"), snaps, "2024-01-11")
    q = snapshot_refresh(spark, snaps, target, ckpt)
    q.awaitTermination(120)
    second = published(spark, target)
    # only the last day's activity rows (lookback 1 day) are re-imported
    assert second == {("r", "2024-01-05"): Decimal("15"), ("c", "2024-01-10"): Decimal("20")}


def test_refresh_published_keeps_whole_days(spark, tmp_dir):
    """The cut falls inside a day: that day's folder is rewritten whole from
    the source, never truncated to the rows after the cut."""
    target = os.path.join(tmp_dir, "pub")
    ts = [datetime.datetime(2024, 1, 9, 6), datetime.datetime(2024, 1, 9, 18),
          datetime.datetime(2024, 1, 10, 12), datetime.datetime(2024, 1, 5, 1)]
    old = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ts)], "k int, date timestamp_ntz, v int")
    publish_by_day(old, target)
    refresh_published(old.withColumn("v", F.lit(2)), target, "date",
                      as_of=datetime.datetime(2024, 1, 10, 12), days=1)  # cut: 01-09 12:00
    got = sorted((r["k"], r["v"]) for r in read_published(spark, target, day_column=None).collect())
    assert got == [(0, 2), (1, 2), (2, 2), (3, 1)]


def test_refresh_published_drops_days_without_rows(spark, tmp_dir):
    """A day of the window that vanished from the source goes, as in memory; a
    failed look at the target is not taken for a missing dataset."""
    target = os.path.join(tmp_dir, "pub")
    ts = [datetime.datetime(2024, 1, d) for d in (7, 9, 10)]
    old = spark.createDataFrame([(i, t) for i, t in enumerate(ts)] + [(9, None)], "k int, date timestamp_ntz")
    publish_by_day(old, target)
    refresh_published(old.filter("k != 1"), target, "date", as_of=ts[-1], days=2)
    kept = sorted(r["k"] for r in read_published(spark, target, day_column=None).collect())
    assert kept == [0, 2, 9]
    memory = incremental_refresh(old, old.filter("k != 1"), "date", ts[-1], days=2)
    assert sorted(r["k"] for r in memory.collect()) == kept
    refresh_published(old.limit(0), target, "date")  # no newest date: nothing happens
    assert read_published(spark, target).count() == 3

"""W1 end to end on sf0.001: snapshot, latest view, report, publish."""
import os

from pyspark.sql import functions as F

from ecotally.operators.latest import create_latest_view
from ecotally.operators.refresh import read_published
from ecotally.operators.shape import geo_roles
from ecotally.plans import fixtures as fx
from ecotally.plans.batch import read_rules_dataset, refresh_rules, run_batch
from ecotally.session import checkpoint_dir, release_scratch
from ecotally.sources.snapshot import list_folders, read_snapshots

SF = "/root/testdata/sf0.001"


def test_batch_snapshot_report_publish(spark, tmp_dir):
    snaps = os.path.join(tmp_dir, "snaps")
    pub = os.path.join(tmp_dir, "published")
    docs, ents = fx.activity_documents(spark, SF), fx.entity_documents(spark, SF)
    run_batch(spark, docs, ents, snaps, as_of="2024-01-30")
    res = run_batch(spark, docs, ents, snaps, as_of="2024-01-31", publish_to=pub)
    assert res.created
    # two dated snapshots on disk, the report reads only the newest
    days = {r["partition_0"] for r in read_snapshots(spark, snaps).select("partition_0").distinct().collect()}
    assert days == {"2024-01-30", "2024-01-31"}
    rows = res.report.collect()
    assert {r["partition_0"] for r in rows} == {"2024-01-31"}
    assert len(rows) == docs.count()
    assert dict(res.report.dtypes)["date"] == "timestamp_ntz"
    assert geo_roles(res.report) == {"country": "COUNTRY", "province": "STATE"}
    assert read_published(spark, pub).count() == len(rows)
    # the report is ordered by entity, then parent (NULLs last)
    keys = [(r["entityid"], r["parententityid"] or "￿") for r in rows]
    assert keys == sorted(keys)
    view = create_latest_view(spark, snaps, "latest_batch")
    assert view.count() == len(rows)
    # a later run refreshes the dataset, and the view follows the newer snapshot
    again = run_batch(spark, docs, ents, snaps, as_of="2024-02-01", publish_to=pub)
    assert again.created is False
    assert {r["partition_0"] for r in spark.table("latest_batch").collect()} == {"2024-02-01"}
    days = {r["partition_0"]: r["n"] for r in again.report.groupBy("partition_0").agg(F.count("*").alias("n")).collect()}
    newest = docs.select(F.to_date(F.max("data.date"), "yyyy/MM/dd")).first()[0]
    window = docs.filter(F.to_date("data.date", "yyyy/MM/dd") >= F.date_sub(F.lit(newest), 1)).count()
    assert days == {"2024-01-31": len(rows) - window, "2024-02-01": window}


def test_report_leaves_no_cache_and_no_scratch(spark, tmp_dir):
    """No persisted frame, no changed session setting; the application's scratch
    folder goes when it is released."""
    before = dict(spark.conf.getAll)
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    run_batch(spark, fx.activity_documents(spark, SF), fx.entity_documents(spark, SF),
              os.path.join(tmp_dir, "snaps"), as_of="2024-01-31").report.collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached
    assert dict(spark.conf.getAll) == before
    release_scratch(spark)
    left = [n for n in list_folders(spark, checkpoint_dir(spark)) if n.startswith("scratch-")]
    assert left == []


def test_missing_static_field_gives_nulls(spark, tmp_dir):
    """A dump whose documents never carried a field still makes a whole snapshot."""
    docs = fx.activity_documents(spark, SF)
    less = docs.withColumn("data", F.col("data").dropFields("emissionInKgCO2_ForMarketBased"))
    res = run_batch(spark, less, fx.entity_documents(spark, SF), os.path.join(tmp_dir, "s"), as_of="2024-01-31")
    rows = res.report.collect()
    assert len(rows) == docs.count() and all(r["emissioninkgco2_formarketbased"] is None for r in rows)


def test_rules_dataset_is_fully_refreshed(spark, tmp_dir):
    path = os.path.join(tmp_dir, "rules")
    ev = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], "tenant string, tenantid string, seq long")
    refresh_rules(spark, path, ev, ["adm"], "u/")  # the first event finds no admin rule
    got = {tuple(r) for r in read_rules_dataset(spark, path).collect()}
    assert got == {("adm", ""), ("u/b/bTenantRole/b", "2")}
    refresh_rules(spark, path, ev, ["adm"], "u/")
    assert read_rules_dataset(spark, path).count() == 3


def test_command_line_batch(spark, tmp_dir):
    from ecotally.__main__ import main

    acts, ents = os.path.join(tmp_dir, "acts"), os.path.join(tmp_dir, "ents")
    fx.activity_documents(spark, SF).write.json(acts)
    fx.entity_documents(spark, SF).write.json(ents)
    out, pub = os.path.join(tmp_dir, "snaps"), os.path.join(tmp_dir, "pub")
    rc = main(["batch", "--activity-table", acts, "--entity-table", ents, "--format", "json",
               "--output-path", out, "--publish-to", pub, "--as-of", "2024-02-01"])
    assert rc == 0
    assert read_published(spark, pub).count() == fx.activity_documents(spark, SF).count()
    assert {r["partition_0"] for r in read_snapshots(spark, out).collect()} == {"2024-02-01"}

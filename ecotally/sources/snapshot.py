"""Dated parquet snapshots (S5, S6) and the published dataset sink.

Layout: one folder per run date.  ``layout="hive"`` (ours, default) writes
``<path>/partition_0=YYYY-MM-DD/`` so Spark discovers ``partition_0`` as a
partition column and prunes folders for a filter on it (including the
latest-partition subquery).  ``layout="bare"`` writes and reads folders named
just ``YYYY-MM-DD/``; reading them all takes ``partition_0`` from each file's
path.  ``snapshot_folders`` lists either layout, newest first.
"""

from __future__ import annotations

import re
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.expressions import run_date

PARTITION_COLUMN = "partition_0"
_BARE_DATE = r"/(\d{4}-\d{2}-\d{2})/[^/]*$"


def write_snapshot(
    df: DataFrame,
    path: str,
    as_of: date | str | None = None,
    mode: str = "overwrite",
    column: str = PARTITION_COLUMN,
    layout: str = "hive",
) -> str:
    """Write ``df`` as the snapshot of ``as_of`` (default: today).

    ``mode="overwrite"`` replaces only that date's folder (dynamic partition
    overwrite), so a same-day rerun is idempotent and older snapshots stay.
    ``mode="append"`` adds files to the date, as a plain per-day writer does.
    Returns the run date written.
    """
    d = str(as_of) if as_of is not None else datetime.now(timezone.utc).strftime("%Y-%m-%d")
    if layout == "bare":  # the date is the folder's name only
        df.write.mode(mode).parquet(f"{path.rstrip('/')}/{d}")
        return d
    tagged = df.withColumn(column, run_date(d))
    writer = tagged.write.mode(mode).partitionBy(column)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)
    return d


def read_snapshots(
    spark: SparkSession,
    path: str,
    layout: str = "hive",
    column: str = PARTITION_COLUMN,
) -> DataFrame:
    """All snapshots under ``path`` with the run date as string ``column``."""
    if layout == "hive":
        df = spark.read.option("basePath", path).parquet(path)
        # Partition values may be inferred as DATE; the date text is the key.
        return df.withColumn(column, F.col(column).cast("string"))
    if layout == "bare":
        df = spark.read.option("recursiveFileLookup", "true").parquet(path)
        return df.withColumn(
            column, F.regexp_extract(F.col("_metadata.file_path"), _BARE_DATE, 1)
        )
    raise ValueError(f"unknown layout {layout!r}")


def list_folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right under ``path``; none if it does not exist."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p):
        return []
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.isDirectory())


def snapshot_folders(spark: SparkSession, path: str, column: str = PARTITION_COLUMN) -> list[tuple[str, str]]:
    """``(run date, folder)`` of the dated folders under ``path``, newest first."""
    named = re.compile(rf"(?:{re.escape(column)}=)?(\d{{4}}-\d{{2}}-\d{{2}})")
    found = [(m[1], f"{path.rstrip('/')}/{n}") for n in list_folders(spark, path) if (m := named.fullmatch(n))]
    return sorted(found, reverse=True)


def register_snapshots(spark: SparkSession, path: str, table: str, column: str = PARTITION_COLUMN) -> list[str]:
    """Keep the catalog table ``table`` over the snapshots under ``path``, of either
    layout: made if missing, new date folders become partitions, those of folders
    that are gone go, and columns that the newest snapshot brought are added.
    Returns the run dates registered now.  Folders are listed and one file's footer
    is read, whatever the number of snapshots.
    """
    folders = dict(snapshot_folders(spark, path, column))
    if not folders:
        raise FileNotFoundError(f"no dated snapshot folder under {path}")

    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    if not spark.catalog.tableExists(table):
        columns = spark.read.parquet(folders[max(folders)]).schema
        spark.sql(
            f"CREATE TABLE {table} ({columns.toDDL()}, `{column}` STRING) USING parquet"
            f" PARTITIONED BY (`{column}`) LOCATION {text(path.rstrip('/'))}"
        )
        known = set()
    else:
        known = {r[0].partition("=")[2] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    new, gone = sorted(set(folders) - known), sorted(known - set(folders))
    if known and new:
        have = {c.lower() for c in spark.table(table).columns}
        added = [f for f in spark.read.parquet(folders[max(folders)]).schema if f.name.lower() not in have]
        if added:
            spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({StructType(added).toDDL()})")
    if new:
        parts = " ".join(f"PARTITION (`{column}` = {text(d)}) LOCATION {text(folders[d])}" for d in new)
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {parts}")
    for d in gone:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION (`{column}` = {text(d)})")
    return new


def publish(df: DataFrame, target: str, mode: str = "overwrite") -> None:
    """Materialise the published dataset (full refresh by default).

    ``target`` is a path (parquet) or a catalog table name.
    """
    if "/" in target or "://" in target:
        df.write.mode(mode).parquet(target)
    else:
        df.write.mode(mode).saveAsTable(target)

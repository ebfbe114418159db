"""F1/V1: the newest snapshot, as a filter, as a folder read, and as a view.

``latest_partition`` is the filter on any DataFrame: ``partition_0 = (SELECT
max(partition_0) ...)``, a scalar subquery that stays a partition filter on a
partition-discovered scan; the subquery reads the partition values of all files.

``latest_snapshot`` is the same over a snapshot folder, without touching older
snapshots: the date folders are listed newest first and the first one that
holds a row is read, whether it is named ``partition_0=YYYY-MM-DD`` or just
``YYYY-MM-DD``.  Folders without rows do not count, as in the filter.

Run dates are ISO text, so string order is date order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshot import PARTITION_COLUMN, snapshot_folders


def latest_partition(df: DataFrame, column: str = PARTITION_COLUMN) -> DataFrame:
    """Rows of the greatest value of ``column`` (NULL partitions never match)."""
    newest = df.select(F.max(column)).scalar()
    return df.filter(F.col(column) == newest)


def latest_snapshot(spark: SparkSession, path: str, column: str = PARTITION_COLUMN) -> DataFrame:
    """The rows of the newest snapshot under ``path`` that has rows, with its run
    date as ``column``.  No snapshot with rows: the newest folder's (empty) rows."""
    empty = None
    for date, folder in snapshot_folders(spark, path, column):
        df = spark.read.parquet(folder).withColumn(column, F.lit(date))
        if not df.isEmpty():
            return df
        empty = df if empty is None else empty
    if empty is None:
        raise FileNotFoundError(f"no dated snapshot folder under {path}")
    return empty


def create_latest_view(
    spark: SparkSession, path: str, name: str = "latest_partition_data", column: str = PARTITION_COLUMN, table: str | None = None
) -> DataFrame:
    """V1: ``CREATE OR REPLACE VIEW name AS`` the newest snapshot under ``path``.

    The view is kept as SQL text, so each use lists the folders again and it
    follows snapshots written later.  The newest date comes from the names of the
    data files alone (a file listing that opens none of them), and is a partition
    filter on the scan: only the newest folder's files are opened.  A folder counts
    once it holds a data file.

    ``table`` is the catalog table that ``register_snapshots`` keeps over the
    folders; folders named by the date alone need it, as a scan of them has no
    partitions of its own.
    """
    quoted = path.rstrip("/").replace("`", "``")
    source = table or f"parquet.`{quoted}`"
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY VIEW `{name}` AS"
        f" SELECT * EXCEPT (`{column}`), CAST(`{column}` AS STRING) AS `{column}` FROM {source}"
        f" WHERE `{column}` = (SELECT max(regexp_extract(path, r'(\\d{{4}}-\\d{{2}}-\\d{{2}})/[^/]*$', 1)) FROM binaryFile.`{quoted}/*/*.parquet`)"
    )
    return spark.table(name)

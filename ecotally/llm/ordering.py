"""Positions of rows in a total order, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row of the partition below


def numbered(df: DataFrame, order: list[str], name: str, group: str | None = None) -> DataFrame:
    """``df``, written, with the columns ``at`` (position from 0), ``n`` (rows in
    all) and, where ``group`` is given, ``group_at``: then positions count within
    the rows of one group, and ``group_at`` is the group's own position.

    Ascending, nulls first, strings by their UTF-8 bytes; rows equal in all of
    ``order`` get positions in any order.  Rows are range partitioned, so a group
    of any size, or a row repeated at will, spreads over many tasks; what meets in
    one place are the row counts of the partitions.
    """
    keys = [group] if group else []
    by = [F.col(c).asc_nulls_first() for c in [*keys, *order, "_tie"]]
    laid = written(
        df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
        .drop("_tie").withColumn("_row", F.monotonically_increasing_id()),
        name,
    ).withColumns({
        "_part": F.shiftright("_row", _ROW_BITS), "_place": F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
    })
    runs = laid.groupBy(*keys, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.select(
        *keys, "_part", (F.sum("_rows").over(upto) - F.col("_rows") - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(whole).alias("n"),
    )
    on = laid["_part"] == F.col("_run_part")
    found = [F.col("_place") + F.col("_shift"), F.col("n")]
    if group:
        groups = numbered(runs.select(group).distinct(), [group], f"{name}-groups")
        groups = groups.select(F.col(group).alias("_own"), F.col("at").alias("group_at"))
        runs = runs.join(groups, F.col(group).eqNullSafe(F.col("_own"))).drop("_own").withColumnRenamed(group, "_run_group")
        on = on & laid[group].eqNullSafe(F.col("_run_group"))
        found.append(F.col("group_at"))
    return laid.join(runs.withColumnRenamed("_part", "_run_part"), on).select(*df.columns, found[0].alias("at"), *found[1:])

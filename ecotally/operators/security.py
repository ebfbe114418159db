"""Row-level security (F2) and maintenance of the rules table.

Rules are ``(UserArn, tenantid)`` rows with ``UserArn`` as the key.  A rule
grants its principal the rows of its tenant; an empty ``tenantid`` grants every
row; a principal without rules sees nothing, and a NULL ``tenantid`` grants
nothing (a lost attribute must not open the data).

Everything here is a lazy plan: rules are read when the result is, not when it
is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import principal_name


def apply_rls(
    df: DataFrame,
    rules: DataFrame,
    principal: str,
    tenant_column: str = "tenantid",
    null_is_unrestricted: bool = False,
) -> DataFrame:
    """the rows of ``df`` that ``principal`` may see.

    One scan of the data: an existence join on the tenant (broadcast by size,
    else a shuffle join), beside one scalar that tells whether the principal
    holds an unrestricted rule.  ``null_is_unrestricted`` opts in to treating a
    rule without tenant like an empty one.
    """
    mine = rules.filter(F.col("UserArn") == F.lit(principal)).select(F.col("tenantid").alias("granted"))
    if null_is_unrestricted:
        mine = mine.select(F.coalesce("granted", F.lit("")).alias("granted"))
    return df.sparkSession.sql(
        "SELECT * FROM {data} WHERE (SELECT coalesce(bool_or(granted = ''), false) FROM {mine})"
        " OR {tenant} IN (SELECT granted FROM {mine} WHERE granted IS NOT NULL)",
        data=df, mine=mine, tenant=F.col(tenant_column),
    )


def create_secured_view(
    spark: SparkSession,
    data: str,
    rules: str,
    name: str,
    tenant_column: str = "tenantid",
    principal: str = "session_user()",
    null_is_unrestricted: bool = False,
    temporary: bool = True,
) -> None:
    """F2 for whoever reads: a view of the table ``data`` that shows each principal
    the rows that the rules grant, so that one dataset serves all of them.

    ``data`` and ``rules`` are catalog tables or views.  Nothing of a principal is
    fixed when the view is made: ``principal`` is SQL that each read evaluates, by
    default the session's user, or e.g. ``concat('urn:user/', session_user())``.
    The rules, and with them new grants, are read when the view is.  A view that is
    not ``temporary`` needs tables that are not either.
    """
    granted = "coalesce(r.tenantid, '')" if null_is_unrestricted else "r.tenantid"
    mine = f"SELECT {granted} AS granted FROM {rules} r WHERE r.UserArn = {principal}"
    spark.sql(
        f"CREATE OR REPLACE {'TEMPORARY ' if temporary else ''}VIEW {name} AS"
        f" SELECT d.* FROM {data} d WHERE (SELECT coalesce(bool_or(granted = ''), false) FROM ({mine}))"
        f" OR d.`{tenant_column}` IN (SELECT granted FROM ({mine}) WHERE granted IS NOT NULL)"
    )


def upsert_rules(rules: DataFrame, grants: DataFrame, order: str = "seq") -> DataFrame:
    """M3: keyed upsert, last write wins per ``UserArn``.

    ``grants`` must have the column ``order`` that says which write is last.
    In-batch duplicates are settled with ``max(struct(order, tenantid))`` per
    key — a partial aggregate, so a principal with very many grants is merged
    map-side instead of sorted in one task.  Existing rules for the keys are
    replaced (left-anti join), all others kept.
    """
    if order not in grants.columns:
        raise ValueError(f"grants need a column {order!r}: without an order no write is the last")
    latest = grants.groupBy("UserArn").agg(
        F.max(F.struct(F.col(order), F.col("tenantid"))).getField("tenantid").alias("tenantid")
    )
    return _replaced(rules, latest)


def _replaced(rules: DataFrame, latest: DataFrame) -> DataFrame:
    """``latest`` (a row per ``UserArn``) and the rules of all other principals."""
    kept = rules.select("UserArn", "tenantid").join(
        latest.select("UserArn"), "UserArn", "left_anti"
    )
    return kept.unionByName(latest)


def tenant_grants(
    events: DataFrame, prefix: str, tenant: str = "tenant", tenant_id: str = "tenantid", order: str = "seq"
) -> DataFrame:
    """Grant rows ``(UserArn, tenantid, seq)`` for tenant-created events."""
    return events.select(
        principal_name(tenant, prefix).alias("UserArn"),
        F.col(tenant_id).cast("string").alias("tenantid"),
        F.col(order).alias("seq"),
    )


def grant(
    rules: DataFrame,
    events: DataFrame,
    admins: Sequence[str],
    prefix: str,
    faithful: bool = True,
) -> DataFrame:
    """M4: apply tenant-created events, in order of ``seq``, to the rules.

    An event that finds the first admin principal without a rule writes the
    admin rows (tenant '') and, with ``faithful=True``, the reference
    behaviour, stores nothing else; every later event finds them and is stored.
    So of a batch only the first event (smallest ``seq``, then principal and
    tenant) can be lost.  ``faithful=False`` stores it too.
    """
    spark = rules.sparkSession
    rows = tenant_grants(events, prefix)
    first = rows.agg(F.min(F.struct("seq", "UserArn", "tenantid")).alias("first"), F.count(F.lit(1)).alias("events"))
    state = first.crossJoin(  # one row each
        rules.agg(F.coalesce(F.bool_or(F.col("UserArn") == F.lit(admins[0])), F.lit(False)).alias("present"))
    ).select(F.struct(F.expr("not present and events > 0").alias("boots"), "first").alias("state")).scalar()
    boots, write = state.getField("boots"), F.struct("seq", "tenantid")
    lost = F.lit(False)
    if faithful:
        lost = boots & F.struct("seq", "UserArn", "tenantid").eqNullSafe(state.getField("first"))
    admin_rows = (
        spark.createDataFrame([(a, "") for a in admins], "UserArn string, tenantid string")
        .filter(boots)
        .withColumn("seq", F.lit(None).cast(rows.schema["seq"].dataType))
    )
    # one partial aggregate: the first event is no write, but its repeats are
    latest = rows.withColumn("lost", lost).unionByName(admin_rows.withColumn("lost", F.lit(False))).groupBy("UserArn").agg(
        F.max(F.when(~F.col("lost"), write)).alias("last"),
        F.max(F.when(F.col("lost"), write)).alias("first"), F.count_if("lost").alias("times"),
    ).select("UserArn", F.coalesce("last", F.when(F.col("times") > 1, F.col("first"))).alias("last")).filter("last IS NOT NULL")
    return _replaced(rules, latest.select("UserArn", "last.tenantid"))

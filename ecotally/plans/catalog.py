"""Registered queries (one per operator of the inventory) and their oracles.

``QUERIES[name](spark, sf_dir)`` returns a DataFrame built only from the given
tables; ``ORACLES[name]`` is DuckDB SQL over the same parquet tables, with the
same column names and types.  Queries that write (snapshots, document dumps)
write below the session's shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import coalesce_amount, contribution, principal_name
from ..operators.latest import create_latest_view, latest_partition, latest_snapshot
from ..operators.refresh import (
    full_refresh,
    incremental_refresh,
    lookback,
    publish_by_day,
    read_published,
    refresh_published,
)
from ..operators.report_schema import report_schema
from ..operators.rollup import (
    attach_totals,
    entity_rollup_report,
    rollup_by_level,
    rollup_contributions,
    rollup_report,
    rollup_totals,
    sort_report,
)
from ..operators.security import apply_rls, create_secured_view, grant
from ..operators.shape import (
    apply_mapping,
    cast_date,
    extract_choice,
    flatten_struct,
    geo_roles,
    residual_to_string,
    tag_geo,
)
from ..session import scratch_path
from ..sources.documents import (
    project_rules,
    read_activity,
    read_documents,
    read_entity,
    read_rules,
)
from ..sources.snapshot import publish, read_snapshots, register_snapshots, write_snapshot
from . import fixtures as fx
from .batch import (
    ACTIVITY_MAPPING,
    flatten_activity,
    joined_inventory,
    read_rules_dataset,
    refresh_rules,
    run_batch,
    secured_report,
    shape_activity,
    shape_entity,
)

Query = Callable[[SparkSession, str], DataFrame]

SNAPSHOT_DATE = "2024-01-31"
RLS_TENANT_PRINCIPAL_KEY = 7  # customer whose principal the tenant RLS query uses
NO_RULE_PRINCIPAL = "urn:bi:user/nobody/nobodyTenantRole/nobody"


# ---------------------------------------------------------------- sources
def q_scan_activity(spark, sf):
    path = scratch_path(spark, "activity-docs")
    fx.activity_documents(spark, sf).write.json(path)
    return shape_activity(read_activity(spark, path, fmt="json"))


def q_scan_entity(spark, sf):
    path = scratch_path(spark, "entity-docs")
    fx.entity_documents(spark, sf).write.json(path)
    return shape_entity(read_entity(spark, path, fmt="json"))


def q_scan_entity_once(spark, sf):
    """S2 with inference in the pass that reads the documents."""
    path = scratch_path(spark, "entity-docs")
    fx.entity_documents(spark, sf).write.json(path)
    return shape_entity(read_entity(spark, path, fmt="json", once=True))


def q_infer_schema(spark, sf):
    """Two document sets with different fields merge into one schema."""
    ev = fx.table(spark, sf, "events")
    base = scratch_path(spark, "event-docs")
    ts = F.col("ts").cast("string").alias("ts")  # all digits; JSON would keep milliseconds
    ev.select("event_id", ts, "event_type", "value").write.json(f"{base}/a")
    ev.select(
        "event_id", ts, "user_id", F.from_json("props", "k long").alias("props")
    ).write.json(f"{base}/b")
    merged = read_documents(spark, [f"{base}/a", f"{base}/b"], fmt="json")
    kinds = dict(merged.dtypes)
    return merged.select(
        "event_id", F.to_timestamp("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value", "user_id",
        F.col("props.k").alias("k"),
        *[F.lit(kinds[c]).alias(f"{c}_type") for c in ("event_id", "value", "user_id", "props")],
    )


def q_scan_rules(spark, sf):
    path = scratch_path(spark, "rules")
    fx.customer_rules(spark, sf).write.parquet(path)
    return read_rules(spark, path)


def q_snapshot_roundtrip(spark, sf):
    path = scratch_path(spark, "snapshots")
    joined = joined_inventory(fx.activity_documents(spark, sf), fx.entity_documents(spark, sf))
    write_snapshot(joined, path, SNAPSHOT_DATE)
    return read_snapshots(spark, path)


def _event_days(spark, sf) -> DataFrame:
    ev = fx.table(spark, sf, "events")
    return ev.withColumn("partition_0", F.date_format("ts", "yyyy-MM-dd"))


def _event_snapshots(spark, sf) -> str:
    """Events written as one snapshot folder per event day, and a newer folder
    without rows, which is not the newest snapshot."""
    path = scratch_path(spark, "event-snapshots")
    days = _event_days(spark, sf)
    days.write.partitionBy("partition_0").parquet(path)
    days.drop("partition_0").limit(0).write.parquet(f"{path}/partition_0=9999-12-31")
    return path


def q_scan_snapshots(spark, sf):
    return read_snapshots(spark, _event_snapshots(spark, sf))


def q_latest_partition(spark, sf):
    return latest_snapshot(spark, _event_snapshots(spark, sf))


def q_latest_partition_filter(spark, sf):
    """The same as a filter on all snapshots."""
    return latest_partition(read_snapshots(spark, _event_snapshots(spark, sf)))


def q_latest_snapshot_bare(spark, sf):
    """Folders named by the date alone: the two newest event days, written one by one."""
    path = scratch_path(spark, "bare-snapshots")
    days = _event_days(spark, sf)
    newest = days.select(F.max("partition_0")).scalar()
    before = days.filter(F.col("partition_0") < newest)
    top = [days.agg(F.max("partition_0")).first()[0], before.agg(F.max("partition_0")).first()[0]]
    for day in filter(None, top):
        rows = days.filter(F.col("partition_0") == day).drop("partition_0")
        write_snapshot(rows, path, day, layout="bare")
    return latest_snapshot(spark, path)


def q_latest_view(spark, sf):
    """V1: a view made before the newest snapshot is written follows it."""
    path = scratch_path(spark, "view-events")
    days = _event_days(spark, sf)
    newest = days.agg(F.max("partition_0")).first()[0]
    days.filter(F.col("partition_0") < newest).write.partitionBy("partition_0").parquet(path)
    name = "latest_" + path.rpartition("-")[2]
    create_latest_view(spark, path, name)
    write_snapshot(days.filter(F.col("partition_0") == newest).drop("partition_0"), path, newest)
    return spark.table(name)


def q_latest_view_bare(spark, sf):
    """V1 over folders named by the date alone, registered as partitions of a catalog
    table; the newest one is written and registered after the view is made."""
    path = scratch_path(spark, "view-bare")
    table, name = "snapshots_" + path.rpartition("-")[2], "latest_" + path.rpartition("-")[2]
    days = _event_days(spark, sf)
    newest = days.select(F.max("partition_0")).scalar()
    before = days.filter(F.col("partition_0") < newest)
    top = days.agg(F.max("partition_0")).first()[0]
    write_snapshot(before.drop("partition_0"), path, before.agg(F.max("partition_0")).first()[0], layout="bare")
    register_snapshots(spark, path, table)
    create_latest_view(spark, path, name, table=table)
    write_snapshot(days.filter(F.col("partition_0") == top).drop("partition_0"), path, top, layout="bare")
    register_snapshots(spark, path, table)
    return spark.table(name)


def q_publish(spark, sf):
    """A published dataset is replaced by the next one."""
    path = scratch_path(spark, "published")
    c = fx.table(spark, sf, "customer")
    publish(c.filter("c_custkey % 2 = 0"), path)
    publish(c.select("c_custkey", "c_name", "c_nationkey"), path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- shaping
def q_flatten_struct(spark, sf):
    return flatten_struct(fx.order_documents(spark, sf).drop("amount"), "data")


def q_choice_extract(spark, sf):
    return extract_choice(fx.order_documents(spark, sf), "amount", "double").select(
        "o_orderkey", "amount"
    )


def q_apply_mapping(spark, sf):
    return apply_mapping(flatten_activity(fx.activity_documents(spark, sf)), ACTIVITY_MAPPING)


def q_dynamic_mapping(spark, sf):
    flat = flatten_activity(fx.activity_documents(spark, sf))
    return residual_to_string(flat, [m[0] for m in ACTIVITY_MAPPING])


def q_nested_mapping(spark, sf):
    return shape_entity(fx.entity_documents(spark, sf))


def q_date_cast(spark, sf):
    o = fx.table(spark, sf, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("date")
    )
    return cast_date(o, "date", "yyy/MM/dd")


def q_geo_tag(spark, sf):
    """Distinct places with the roles that the report's columns carry."""
    tagged = tag_geo(shape_entity(fx.entity_documents(spark, sf)))
    roles = geo_roles(tagged)
    return tagged.groupBy("country", "province").agg(F.count(F.lit(1)).alias("entities")).select(
        "*", F.lit(roles.get("country")).alias("country_role"), F.lit(roles.get("province")).alias("province_role")
    )


def q_report_schema(spark, sf):
    """The report's columns and BI types, and how many of its rows fill each."""
    v = fx.rollup_view(spark, sf).withColumn("lines", F.lit(1).cast("long"))
    filled = v.select([F.count(F.col(c)).alias(c) for c in v.columns]).unpivot(
        [], v.columns, "name", "filled"
    )
    return report_schema(v).join(filled, "name", "left").select("name", "type", "filled")


# ---------------------------------------------------------------- joins
def q_activity_entity_join(spark, sf):
    return joined_inventory(fx.activity_documents(spark, sf), fx.entity_documents(spark, sf))


# ---------------------------------------------------------------- roll-up
def q_coalesce_amounts(spark, sf):
    v = fx.rollup_view(spark, sf)
    return v.select(
        "entityid",
        "activityid",
        coalesce_amount("emissioninkgco2", "emissioninkgco2_forlocationbased").alias(
            "amount_locationbased"
        ),
        coalesce_amount("emissioninkgco2", "emissioninkgco2_formarketbased").alias(
            "amount_marketbased"
        ),
    )


def q_decimal_contribution(spark, sf):
    v = fx.rollup_view(spark, sf)
    p = "parentcontributionpercentage"
    return v.select(
        "entityid",
        "activityid",
        contribution(coalesce_amount("emissioninkgco2", "emissioninkgco2_forlocationbased"), p)
        .alias("amount_locationbased"),
        contribution(coalesce_amount("emissioninkgco2", "emissioninkgco2_formarketbased"), p)
        .alias("amount_marketbased"),
    )


def latest_view(spark, sf) -> DataFrame:
    """V as the reference reads it: written once as the dated snapshot, then
    the newest partition of the snapshot folder (a partition-pruned scan)."""
    path = scratch_path(spark, "view-snapshots")
    write_snapshot(fx.rollup_view(spark, sf), path, SNAPSHOT_DATE)
    return latest_snapshot(spark, path)


def q_rollup_contributions(spark, sf):
    return rollup_contributions(latest_view(spark, sf))


def q_rollup_by_level(spark, sf):
    return rollup_by_level(latest_view(spark, sf))


def q_entity_totals(spark, sf):
    return rollup_totals(latest_view(spark, sf))


def q_total_attach(spark, sf):
    v = latest_view(spark, sf)
    return attach_totals(v, rollup_totals(v))


def q_report_sorted(spark, sf):
    return sort_report(fx.rollup_view(spark, sf))


def q_rollup_report(spark, sf):
    return rollup_report(latest_view(spark, sf))


def q_rollup_report_entity(spark, sf):
    """The roll-up with the reference's quirks fixed (never the default)."""
    return entity_rollup_report(latest_view(spark, sf))


# ---------------------------------------------------------------- security
def _rules(spark, sf, with_admins: bool = True) -> DataFrame:
    return project_rules(fx.customer_rules(spark, sf, with_admins=with_admins))


def _rls(spark, sf, principal: str) -> DataFrame:
    return apply_rls(fx.activity_rows(spark, sf), _rules(spark, sf), principal)


def _customer_principal(key: int) -> str:
    t = f"c{key}"
    return f"{fx.PRINCIPAL_PREFIX}{t}/{t}TenantRole/{t}"


def q_rls_tenant(spark, sf):
    return _rls(spark, sf, _customer_principal(RLS_TENANT_PRINCIPAL_KEY))


def q_rls_reader(spark, sf):
    """F2 by a view that names no principal: the session's user holds the rule of one
    customer here, and reads the dataset that all share."""
    key = uuid.uuid4().hex[:12]
    held = _rules(spark, sf).filter(F.col("UserArn") == _customer_principal(RLS_TENANT_PRINCIPAL_KEY))
    rules = _rules(spark, sf).unionByName(held.withColumn("UserArn", F.concat(F.lit("urn:reader/"), F.session_user())))
    rules.createOrReplaceTempView(f"rules_{key}")
    fx.activity_rows(spark, sf).createOrReplaceTempView(f"data_{key}")
    create_secured_view(spark, f"data_{key}", f"rules_{key}", f"seen_{key}", principal="concat('urn:reader/', session_user())")
    return spark.table(f"seen_{key}")


def q_rls_admin(spark, sf):
    return _rls(spark, sf, fx.ADMIN_PRINCIPALS[0])


def q_rls_no_rule(spark, sf):
    return _rls(spark, sf, NO_RULE_PRINCIPAL)


def q_principal_name(spark, sf):
    c = fx.table(spark, sf, "customer")
    tenant = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    return c.select("c_custkey", principal_name(tenant, fx.PRINCIPAL_PREFIX).alias("UserArn"))


def q_grant_upsert(spark, sf):
    rules = _rules(spark, sf, with_admins=True)
    return grant(rules, fx.grant_events(spark, sf), fx.ADMIN_PRINCIPALS, fx.PRINCIPAL_PREFIX)


def q_grant_bootstrap(spark, sf):
    rules = _rules(spark, sf, with_admins=False)
    return grant(rules, fx.grant_events(spark, sf), fx.ADMIN_PRINCIPALS, fx.PRINCIPAL_PREFIX)


# ---------------------------------------------------------------- refresh
def _newest_event(ev: DataFrame):
    return ev.select(F.max("ts")).scalar()


def q_lookback_filter(spark, sf):
    ev = fx.table(spark, sf, "events")
    return lookback(ev, "ts", _newest_event(ev), days=1)


def q_incremental_refresh(spark, sf):
    source = fx.table(spark, sf, "events")
    target = source.withColumn("value", F.col("value") + F.lit(1000.0))
    return incremental_refresh(target, source, "ts", _newest_event(source), days=1)


def q_refresh_published(spark, sf):
    """M1 on disk: a day-partitioned dataset of stale events, refreshed with a
    2-day lookback from events that have lost the day before the newest."""
    events = fx.table(spark, sf, "events")
    path = scratch_path(spark, "published-events")
    publish_by_day(events.withColumn("value", F.col("value") + F.lit(1000.0)), path, "ts")
    newest = events.agg(F.max("ts")).first()[0]
    source = events.filter(F.to_date("ts") != F.date_sub(F.to_date(F.lit(newest)), 1))
    refresh_published(source, path, "ts", as_of=newest, days=2)
    return read_published(spark, path, day_column=None)


# ---------------------------------------------------------------- batch
def _published_batch(spark, sf):
    return run_batch(
        spark,
        fx.activity_documents(spark, sf),
        fx.entity_documents(spark, sf),
        scratch_path(spark, "batch-snapshots"),
        as_of=SNAPSHOT_DATE,
        publish_to=scratch_path(spark, "batch-report"),
    )


def q_batch_report(spark, sf):
    """The report as read from the published dataset."""
    return _published_batch(spark, sf).report


def _rules_dataset(spark, sf) -> str:
    path = scratch_path(spark, "rules-dataset")
    full_refresh(_rules(spark, sf, with_admins=True), path)
    refresh_rules(spark, path, fx.grant_events(spark, sf), fx.ADMIN_PRINCIPALS, fx.PRINCIPAL_PREFIX)
    return path


def q_full_refresh(spark, sf):
    """M2: the rules dataset after grants and its full refresh."""
    return read_rules_dataset(spark, _rules_dataset(spark, sf))


def q_pipeline_rls(spark, sf):
    """W1's end: the published report as one principal sees it by the refreshed rules."""
    return secured_report(
        _published_batch(spark, sf).report, _rules_dataset(spark, sf), _customer_principal(RLS_TENANT_PRINCIPAL_KEY)
    )


QUERIES: dict[str, Query] = {
    "scan_activity": q_scan_activity,
    "scan_entity": q_scan_entity,
    "scan_entity_once": q_scan_entity_once,
    "infer_schema": q_infer_schema,
    "scan_rules": q_scan_rules,
    "snapshot_roundtrip": q_snapshot_roundtrip,
    "scan_snapshots": q_scan_snapshots,
    "latest_partition": q_latest_partition,
    "latest_partition_filter": q_latest_partition_filter,
    "latest_snapshot_bare": q_latest_snapshot_bare,
    "latest_view": q_latest_view,
    "latest_view_bare": q_latest_view_bare,
    "publish": q_publish,
    "flatten_struct": q_flatten_struct,
    "choice_extract": q_choice_extract,
    "apply_mapping": q_apply_mapping,
    "dynamic_mapping": q_dynamic_mapping,
    "nested_mapping": q_nested_mapping,
    "date_cast": q_date_cast,
    "geo_tag": q_geo_tag,
    "report_schema": q_report_schema,
    "activity_entity_join": q_activity_entity_join,
    "coalesce_amounts": q_coalesce_amounts,
    "decimal_contribution": q_decimal_contribution,
    "rollup_contributions": q_rollup_contributions,
    "rollup_by_level": q_rollup_by_level,
    "entity_totals": q_entity_totals,
    "total_attach": q_total_attach,
    "report_sorted": q_report_sorted,
    "rollup_report": q_rollup_report,
    "rollup_report_entity": q_rollup_report_entity,
    "rls_tenant": q_rls_tenant,
    "rls_reader": q_rls_reader,
    "rls_admin": q_rls_admin,
    "rls_no_rule": q_rls_no_rule,
    "principal_name": q_principal_name,
    "grant_upsert": q_grant_upsert,
    "grant_bootstrap": q_grant_bootstrap,
    "lookback_filter": q_lookback_filter,
    "incremental_refresh": q_incremental_refresh,
    "refresh_published": q_refresh_published,
    "batch_report": q_batch_report,
    "full_refresh": q_full_refresh,
    "pipeline_rls": q_pipeline_rls,
}


# =============================================================== oracles
_T = "'t' || CAST({k} % 4 AS VARCHAR)"

_ACTIVITY_CTE = f"""
g AS (
  SELECT l_suppkey, l_returnflag,
         SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS ep,
         SUM(CAST(l_quantity AS DECIMAL(18,2))) AS qty,
         SUM(CAST(l_tax AS DECIMAL(18,2))) AS tax,
         MAX(l_shipdate) AS shipdate,
         COUNT(*) AS lines
  FROM lineitem GROUP BY l_suppkey, l_returnflag
),
flat AS (
  SELECT {_T.format(k='l_suppkey')} || '#' || CAST(l_suppkey AS VARCHAR) || '-' || l_returnflag
           AS tenantactivitykey,
         l_returnflag AS activityid,
         CAST(l_suppkey AS VARCHAR) AS entityid,
         'F' || l_returnflag AS formid,
         {_T.format(k='l_suppkey')} AS tenantid,
         CAST(lines % 7 AS INTEGER) AS versionid,
         CAST(CASE WHEN l_returnflag = 'A' THEN ep END AS DOUBLE) AS emissioninkgco2,
         CAST(CASE WHEN l_returnflag <> 'A' THEN qty END AS DOUBLE)
           AS emissioninkgco2_forlocationbased,
         CAST(CASE WHEN l_returnflag = 'N' THEN tax END AS DOUBLE)
           AS emissioninkgco2_formarketbased,
         strftime(shipdate, '%Y/%m/%d') AS date,
         lines AS linecount
  FROM g
),
act AS (
  -- Spark turns a double into a decimal through its shortest decimal text.
  SELECT tenantactivitykey, activityid,
         CAST(CAST(emissioninkgco2 AS VARCHAR) AS DECIMAL(20,10)) AS emissioninkgco2,
         CAST(CAST(emissioninkgco2_forlocationbased AS VARCHAR) AS DECIMAL(20,10))
           AS emissioninkgco2_forlocationbased,
         CAST(CAST(emissioninkgco2_formarketbased AS VARCHAR) AS DECIMAL(20,10))
           AS emissioninkgco2_formarketbased,
         entityid, formid, tenantid, versionid,
         date, CAST(linecount AS VARCHAR) AS linecount
  FROM flat
)"""

_ENTITY_CTE = f"""
ent AS (
  SELECT {_T.format(k='s_suppkey')} || '#' || CAST(s_suppkey AS VARCHAR) AS tenantentitykey,
         CAST(s_suppkey AS VARCHAR) AS entity_id,
         {_T.format(k='s_suppkey')} AS tenant_id,
         printf('%.2f', s_acctbal) AS baseline,
         'S' || CAST(s_suppkey AS VARCHAR) AS code,
         CASE WHEN s_suppkey % 2 = 0 THEN 'equity' ELSE 'control' END AS consolidateapproach,
         n_name AS country,
         'industry-' || CAST(s_suppkey % 6 AS VARCHAR) AS industry,
         'manager-' || CAST(s_suppkey % 9 AS VARCHAR) AS manager,
         CASE WHEN s_suppkey % 3 = 0 THEN 'owned' ELSE 'leased' END AS operatingtype,
         CAST((s_suppkey % 4) * 25 AS VARCHAR) AS ownershipconsolidatepercentage,
         CAST((s_suppkey % 5) * 20 AS VARCHAR) AS ownershippercentage,
         n_name || '-P' || CAST(s_suppkey % 7 AS VARCHAR) AS province,
         s_name AS name,
         CAST(CAST((s_suppkey % 5) * 0.25 AS DOUBLE) AS DECIMAL(10,2))
           AS parentcontributionpercentage,
         CASE WHEN s_suppkey // 4 = 0 THEN NULL
              ELSE CAST(((s_suppkey // 4 - 1) // 3) * 4 + s_suppkey % 4 AS VARCHAR) END
           AS parententityid
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""

_JOINED_CTE = f"""{_ACTIVITY_CTE},
{_ENTITY_CTE},
joined AS (
  SELECT a.*, e.tenantentitykey, e.baseline, e.code, e.consolidateapproach, e.country,
         e.industry, e.manager, e.operatingtype, e.ownershipconsolidatepercentage,
         e.ownershippercentage, e.province, e.name, e.parentcontributionpercentage,
         e.parententityid
  FROM act a JOIN ent e ON a.entityid = e.entity_id AND a.tenantid = e.tenant_id
)"""

_V = fx.ROLLUP_VIEW_SQL.strip()
_C = fx.ROLLUP_CTE_SQL.strip()

_TOTALS = """
  SELECT place AS id, SUM(by_location * weight)::DECIMAL(30,10) AS cumulative_locationbased,
         SUM(by_market * weight)::DECIMAL(30,10) AS cumulative_marketbased
  FROM walk GROUP BY place"""

_REPORT = f"""
SELECT v.*, '{SNAPSHOT_DATE}' AS partition_0,
       gathered.cumulative_locationbased AS total_emissions_locationbased,
       gathered.cumulative_marketbased AS total_emissions_marketbased
FROM v, ({_TOTALS}) gathered WHERE gathered.id = v.entityid"""

_RULES = """
rules AS (
  SELECT 'urn:bi:user/' || 'c' || CAST(c_custkey AS VARCHAR) || '/' || 'c' || CAST(c_custkey AS VARCHAR)
           || 'TenantRole/' || 'c' || CAST(c_custkey AS VARCHAR) AS UserArn,
         't' || CAST(c_nationkey % 4 AS VARCHAR) AS tenantid
  FROM customer
),
admins AS (
  SELECT * FROM (VALUES ('urn:bi:user/default/admin', ''),
                        ('urn:bi:user/default/operator', ''),
                        ('urn:bi:user/default/viewer', '')) AS a(UserArn, tenantid)
),
grants AS (
  SELECT 'urn:bi:user/' || 'c' || CAST(o_custkey AS VARCHAR) || '/' || 'c' || CAST(o_custkey AS VARCHAR)
           || 'TenantRole/' || 'c' || CAST(o_custkey AS VARCHAR) AS UserArn,
         arg_max('t' || CAST(o_orderkey % 4 AS VARCHAR), o_orderkey) AS tenantid
  FROM orders GROUP BY o_custkey
)"""

_ACTIVITY_ROWS = """
SELECT l_orderkey, l_linenumber, l_suppkey, 't' || CAST(l_suppkey % 4 AS VARCHAR) AS tenantid,
       l_extendedprice
FROM lineitem"""

_EVENT_DAY = "strftime(ts, '%Y-%m-%d')"

ORACLES: dict[str, str] = {
    "scan_activity": f"WITH {_ACTIVITY_CTE} SELECT * FROM act",
    "scan_entity": f"WITH {_ENTITY_CTE} SELECT * FROM ent",
    "scan_entity_once": f"WITH {_ENTITY_CTE} SELECT * FROM ent",
    "scan_rules": f"WITH {_RULES} SELECT * FROM rules UNION ALL SELECT * FROM admins",
    "snapshot_roundtrip": f"WITH {_JOINED_CTE} SELECT *, '{SNAPSHOT_DATE}' AS partition_0 FROM joined",
    "scan_snapshots": f"SELECT *, {_EVENT_DAY} AS partition_0 FROM events",
    "latest_partition": f"""
        SELECT *, {_EVENT_DAY} AS partition_0 FROM events
        WHERE {_EVENT_DAY} = (SELECT MAX({_EVENT_DAY}) FROM events)""",
    "flatten_struct": """
        SELECT o_orderkey, 't' || CAST(o_orderkey % 4 AS VARCHAR) AS tenantid,
               o_orderstatus AS orderstatus, o_totalprice AS totalprice,
               strftime(o_orderdate, '%Y/%m/%d') AS orderdate, o_orderpriority AS orderpriority
        FROM orders""",
    "choice_extract": """
        SELECT o_orderkey,
               CASE WHEN starts_with(o_orderpriority, '1') THEN NULL ELSE o_totalprice END AS amount
        FROM orders""",
    "apply_mapping": f"""
        WITH {_ACTIVITY_CTE}
        SELECT tenantactivitykey, activityid, emissioninkgco2, emissioninkgco2_forlocationbased,
               emissioninkgco2_formarketbased, entityid, formid, tenantid, versionid
        FROM act""",
    "dynamic_mapping": f"WITH {_ACTIVITY_CTE} SELECT date, linecount FROM act",
    "nested_mapping": f"WITH {_ENTITY_CTE} SELECT * FROM ent",
    "geo_tag": f"""
        WITH {_ENTITY_CTE}
        SELECT country, province, COUNT(*) AS entities, 'COUNTRY' AS country_role, 'STATE' AS province_role
        FROM ent GROUP BY country, province""",
    "infer_schema": """
        SELECT event_id, ts, event_type, value, NULL::BIGINT AS user_id, NULL::BIGINT AS k,
               'bigint' AS event_id_type, 'double' AS value_type, 'bigint' AS user_id_type, 'struct<k:bigint>' AS props_type
        FROM events
        UNION ALL
        SELECT event_id, ts, NULL, NULL, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT),
               'bigint', 'double', 'bigint', 'struct<k:bigint>'
        FROM events""",
    "report_schema": f"""
        WITH {_V}
        SELECT name, type, filled FROM (VALUES
          ('entityid', 'STRING'), ('tenantid', 'STRING'), ('parententityid', 'STRING'), ('activityid', 'STRING'),
          ('emissioninkgco2', 'DECIMAL'), ('emissioninkgco2_forlocationbased', 'DECIMAL'),
          ('emissioninkgco2_formarketbased', 'DECIMAL'), ('parentcontributionpercentage', 'DECIMAL'), ('lines', 'INTEGER'),
          ('total_emissions_marketbased', 'DECIMAL'), ('total_emissions_locationbased', 'DECIMAL')) AS c(name, type)
        LEFT JOIN (UNPIVOT (
          SELECT COUNT(entityid) AS entityid, COUNT(tenantid) AS tenantid, COUNT(parententityid) AS parententityid,
                 COUNT(activityid) AS activityid, COUNT(emissioninkgco2) AS emissioninkgco2,
                 COUNT(emissioninkgco2_forlocationbased) AS emissioninkgco2_forlocationbased,
                 COUNT(emissioninkgco2_formarketbased) AS emissioninkgco2_formarketbased,
                 COUNT(parentcontributionpercentage) AS parentcontributionpercentage, COUNT(*) AS lines FROM v)
          ON COLUMNS(*) INTO NAME name VALUE filled) USING (name)""",
    "latest_partition_filter": f"""
        SELECT *, {_EVENT_DAY} AS partition_0 FROM events
        WHERE {_EVENT_DAY} = (SELECT MAX({_EVENT_DAY}) FROM events)""",
    "latest_snapshot_bare": f"""
        SELECT *, {_EVENT_DAY} AS partition_0 FROM events
        WHERE {_EVENT_DAY} = (SELECT MAX({_EVENT_DAY}) FROM events)""",
    "latest_view": f"""
        SELECT *, {_EVENT_DAY} AS partition_0 FROM events
        WHERE {_EVENT_DAY} = (SELECT MAX({_EVENT_DAY}) FROM events)""",
    "latest_view_bare": f"""
        SELECT *, {_EVENT_DAY} AS partition_0 FROM events
        WHERE {_EVENT_DAY} = (SELECT MAX({_EVENT_DAY}) FROM events)""",
    "publish": "SELECT c_custkey, c_name, c_nationkey FROM customer",
    "date_cast": """
        SELECT o_orderkey, strptime(strftime(o_orderdate, '%Y/%m/%d'), '%Y/%m/%d') AS date
        FROM orders""",
    "activity_entity_join": f"WITH {_JOINED_CTE} SELECT * FROM joined",
    "coalesce_amounts": f"""
        WITH {_V}
        SELECT entityid, activityid,
               COALESCE(emissioninkgco2, emissioninkgco2_forlocationbased, 0) AS amount_locationbased,
               COALESCE(emissioninkgco2, emissioninkgco2_formarketbased, 0) AS amount_marketbased
        FROM v""",
    "decimal_contribution": f"""
        WITH {_V}
        SELECT entityid, activityid,
               CAST(COALESCE(emissioninkgco2, emissioninkgco2_forlocationbased, 0)
                    * parentcontributionpercentage AS DECIMAL(20,10)) AS amount_locationbased,
               CAST(COALESCE(emissioninkgco2, emissioninkgco2_formarketbased, 0)
                    * parentcontributionpercentage AS DECIMAL(20,10)) AS amount_marketbased
        FROM v""",
    "rollup_contributions": f"""
        WITH RECURSIVE {_V}, {_C}
        SELECT place AS id, tenant AS tenantid, origin AS rootid, by_location AS amount_locationbased,
               by_market AS amount_marketbased, share AS percentage, depth AS level, SUM(weight)::DECIMAL(38,0) AS n
        FROM walk GROUP BY ALL""",
    "rollup_by_level": f"""
        WITH RECURSIVE {_V}, {_C}
        SELECT place AS id, depth AS level,
               SUM(by_location * weight)::DECIMAL(30,10) AS amount_locationbased,
               SUM(by_market * weight)::DECIMAL(30,10) AS amount_marketbased, SUM(weight)::DECIMAL(38,0) AS n
        FROM walk GROUP BY ALL""",
    "entity_totals": f"WITH RECURSIVE {_V}, {_C} {_TOTALS}",
    "total_attach": f"WITH RECURSIVE {_V}, {_C} {_REPORT}",
    "report_sorted": f"WITH {_V} SELECT * FROM v ORDER BY entityid, parententityid",
    "rollup_report": f"WITH RECURSIVE {_V}, {_C} {_REPORT} ORDER BY entityid, parententityid",
    "rollup_report_entity": f"""
        WITH RECURSIVE {_V},
        links AS (SELECT DISTINCT tenantid AS tenant, entityid AS child, parententityid AS above, parentcontributionpercentage AS share FROM v),
        walk(tenant, place, by_location, by_market) AS (
          SELECT tenantid, entityid, COALESCE(emissioninkgco2, emissioninkgco2_forlocationbased, 0),
                 COALESCE(emissioninkgco2, emissioninkgco2_formarketbased, 0) FROM v
          UNION ALL
          SELECT l.tenant, l.above, (by_location * share)::DECIMAL(20,10), (by_market * share)::DECIMAL(20,10)
          FROM links l, walk w WHERE (l.tenant, l.child) = (w.tenant, w.place)),
        gathered AS (
          SELECT tenant, place, SUM(by_market)::DECIMAL(30,10) AS total_emissions_marketbased,
                 SUM(by_location)::DECIMAL(30,10) AS total_emissions_locationbased FROM walk GROUP BY ALL)
        SELECT v.*, '{SNAPSHOT_DATE}' AS partition_0, total_emissions_marketbased, total_emissions_locationbased
        FROM v, gathered WHERE tenant = tenantid AND place = entityid""",
    "rls_tenant": f"""
        {_ACTIVITY_ROWS}
        WHERE 't' || CAST(l_suppkey % 4 AS VARCHAR) IN (
          SELECT 't' || CAST(c_nationkey % 4 AS VARCHAR) FROM customer
          WHERE c_custkey = {RLS_TENANT_PRINCIPAL_KEY})""",
    "rls_reader": f"""
        {_ACTIVITY_ROWS}
        WHERE 't' || CAST(l_suppkey % 4 AS VARCHAR) IN (
          SELECT 't' || CAST(c_nationkey % 4 AS VARCHAR) FROM customer
          WHERE c_custkey = {RLS_TENANT_PRINCIPAL_KEY})""",
    "rls_admin": _ACTIVITY_ROWS,
    "rls_no_rule": f"""
        WITH {_RULES}, held AS (
          SELECT tenantid FROM (SELECT * FROM rules UNION ALL SELECT * FROM admins) WHERE UserArn = '{NO_RULE_PRINCIPAL}')
        SELECT a.* FROM ({_ACTIVITY_ROWS}) a
        WHERE EXISTS (SELECT 1 FROM held h WHERE h.tenantid = '' OR h.tenantid = a.tenantid)""",
    "principal_name": """
        SELECT c_custkey, 'urn:bi:user/' || 'c' || CAST(c_custkey AS VARCHAR) || '/' || 'c'
               || CAST(c_custkey AS VARCHAR) || 'TenantRole/' || 'c' || CAST(c_custkey AS VARCHAR)
               AS UserArn
        FROM customer""",
    "grant_upsert": f"""
        WITH {_RULES},
        all_rules AS (SELECT * FROM rules UNION ALL SELECT * FROM admins)
        SELECT * FROM all_rules WHERE UserArn NOT IN (SELECT UserArn FROM grants)
        UNION ALL SELECT UserArn, tenantid FROM grants""",
    # the first order finds no admin rule: it writes the admin rows and is not stored itself
    "grant_bootstrap": f"""
        WITH {_RULES},
        stored AS (
          SELECT 'urn:bi:user/' || 'c' || CAST(o_custkey AS VARCHAR) || '/' || 'c' || CAST(o_custkey AS VARCHAR)
                   || 'TenantRole/' || 'c' || CAST(o_custkey AS VARCHAR) AS UserArn,
                 't' || CAST(o_orderkey % 4 AS VARCHAR) AS tenantid,
                 row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS back
          FROM orders WHERE o_orderkey <> (SELECT MIN(o_orderkey) FROM orders))
        SELECT * FROM admins
        UNION ALL SELECT UserArn, tenantid FROM stored WHERE back = 1
        UNION ALL SELECT * FROM rules r WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.UserArn = r.UserArn)""",
    "lookback_filter": """
        SELECT * FROM events WHERE ts >= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY""",
    "incremental_refresh": """
        WITH cut AS (SELECT MAX(ts) - INTERVAL 1 DAY AS c FROM events)
        SELECT event_id, ts, user_id, event_type, value + 1000.0 AS value, props
        FROM events WHERE ts < (SELECT c FROM cut) OR ts IS NULL
        UNION ALL
        SELECT * FROM events WHERE ts >= (SELECT c FROM cut)""",
    "refresh_published": """
        WITH newest AS (SELECT MAX(ts) AS t, CAST(MAX(ts) AS DATE) AS d FROM events),
        dated AS (SELECT *, CAST(ts AS DATE) AS date_day FROM events),
        first AS (SELECT CAST(t - INTERVAL 2 DAY AS DATE) AS f FROM newest)
        SELECT event_id, ts, user_id, event_type, value + 1000.0 AS value, props, date_day
        FROM dated WHERE date_day < (SELECT f FROM first) OR ts IS NULL
        UNION ALL
        SELECT * FROM dated
        WHERE date_day >= (SELECT f FROM first) AND date_day <> (SELECT d - 1 FROM newest)""",
    "batch_report": f"""
        WITH RECURSIVE {_JOINED_CTE},
        v AS (SELECT * FROM joined),
        {_C},
        rep AS ({_REPORT})
        SELECT * REPLACE (strptime(date, '%Y/%m/%d') AS date) FROM rep""",
    "full_refresh": f"""
        WITH {_RULES},
        every AS (SELECT *, 0 AS new FROM rules UNION ALL SELECT *, 0 FROM admins UNION ALL SELECT *, 1 FROM grants)
        SELECT UserArn, arg_max(tenantid, new) AS tenantid FROM every GROUP BY UserArn""",
    "pipeline_rls": f"""
        WITH RECURSIVE {_JOINED_CTE},
        v AS (SELECT * FROM joined),
        {_C},
        rep AS ({_REPORT}),
        held AS (
          SELECT COALESCE(
            (SELECT arg_max('t' || CAST(o_orderkey % 4 AS VARCHAR), o_orderkey) FROM orders
             WHERE o_custkey = {RLS_TENANT_PRINCIPAL_KEY}),
            (SELECT 't' || CAST(c_nationkey % 4 AS VARCHAR) FROM customer
             WHERE c_custkey = {RLS_TENANT_PRINCIPAL_KEY})) AS tenantid)
        SELECT rep.* REPLACE (strptime(date, '%Y/%m/%d') AS date) FROM rep
        WHERE tenantid = (SELECT tenantid FROM held)""",
}

"""The end-to-end batch as one Spark application.

scan -> shape (flatten, choice, static + residual mapping) -> join entity ->
dated snapshot -> newest snapshot -> roll-up report -> date cast + geo tags ->
published dataset (created or refreshed) -> row-level security by the rules
dataset, itself fully refreshed after grants.  Reading the snapshot back gives
the roll-up a scan of the newest folder alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.join import join_activity_entity
from ..operators.latest import latest_snapshot
from ..operators.refresh import full_refresh, publish_or_refresh, read_published
from ..operators.rollup import rollup_report, sort_report
from ..operators.security import apply_rls, grant
from ..operators.shape import (
    apply_mapping,
    cast_date,
    extract_choice,
    flatten_struct,
    residual_mappings,
    tag_geo,
)
from ..sources.committed import CommitConflict, newest_commit, read_committed, vacuum
from ..sources.snapshot import write_snapshot

# Static mapping of the activity documents
# (source, source type, target, target type), in this order.
ACTIVITY_MAPPING = [
    ("tenantactivitykey", "string", "tenantactivitykey", "string"),
    ("activityid", "string", "activityid", "string"),
    ("emissioninkgco2", "double", "emissioninkgco2", "decimal(20,10)"),
    ("emissioninkgco2_forlocationbased", "double", "emissioninkgco2_forlocationbased", "decimal(20,10)"),
    ("emissioninkgco2_formarketbased", "double", "emissioninkgco2_formarketbased", "decimal(20,10)"),
    ("entityid", "string", "entityid", "string"),
    ("formid", "string", "formid", "string"),
    ("tenantid", "string", "tenantid", "string"),
    ("versionid", "int", "versionid", "int"),
]

# The three choice-typed emission fields of an activity.
EMISSION_FIELDS = [
    "emissionInKgCO2",
    "emissionInKgCO2_ForLocationBased",
    "emissionInKgCO2_ForMarketBased",
]

# Static mapping of the entity documents, in this order.  The
# bare ``decimal`` target takes the configured default precision.
ENTITY_MAPPING = [
    ("tenantentitykey", "string", "tenantentitykey", "string"),
    ("entityid", "string", "entity_id", "string"),
    ("tenantid", "string", "tenant_id", "string"),
    ("data.baseline", "string", "baseline", "string"),
    ("data.code", "string", "code", "string"),
    ("data.consolidateApproach", "string", "consolidateapproach", "string"),
    ("data.country", "string", "country", "string"),
    ("data.industry", "string", "industry", "string"),
    ("data.manager", "string", "manager", "string"),
    ("data.operatingType", "string", "operatingtype", "string"),
    ("data.ownershipConsolidatePercentage", "string", "ownershipconsolidatepercentage", "string"),
    ("data.ownershipPercentage", "string", "ownershippercentage", "string"),
    ("data.province", "string", "province", "string"),
    ("name", "string", "name", "string"),
    ("parentcontributionpercentage", "double", "parentcontributionpercentage", "decimal"),
    ("parententityid", "string", "parententityid", "string"),
]


def flatten_activity(df: DataFrame, strict_choice: bool = True) -> DataFrame:
    """P1 + P2: flatten ``data`` and keep the double arm of the emissions."""
    flat = flatten_struct(df, "data")
    for field in EMISSION_FIELDS:
        flat = extract_choice(flat, field, "double", strict=strict_choice, missing_ok=True)
    return flat


def shape_activity(df: DataFrame, strict_choice: bool = True, **mapping_opts) -> DataFrame:
    """Activity documents -> typed activity rows (P1-P4).  The static columns
    always exist, as NULLs where no document carried them."""
    flat = flatten_activity(df, strict_choice)
    static = [m[0] for m in ACTIVITY_MAPPING]
    mapping_opts.setdefault("fill", True)
    return apply_mapping(flat, ACTIVITY_MAPPING + residual_mappings(flat, static), **mapping_opts)


def shape_entity(df: DataFrame, **mapping_opts) -> DataFrame:
    """Entity documents -> typed entity rows (P5), every mapped column included."""
    mapping_opts.setdefault("fill", True)
    return apply_mapping(df, ENTITY_MAPPING, **mapping_opts)


def joined_inventory(activity_docs: DataFrame, entity_docs: DataFrame, **opts) -> DataFrame:
    """Shaped activity ⋈ shaped entity (J1 + P6): the snapshot's rows."""
    return join_activity_entity(shape_activity(activity_docs), shape_entity(entity_docs), **opts)


@dataclass
class BatchResult:
    report: DataFrame | None
    snapshot_path: str
    run_date: str
    created: bool | None = None  # whether the published dataset was created; None: not published


def run_batch(
    spark: SparkSession,
    activity_docs: DataFrame,
    entity_docs: DataFrame,
    snapshot_path: str,
    as_of: str | None = None,
    publish_to: str | None = None,
    snapshot_mode: str = "overwrite",
    sort: bool = True,
    build_report: bool = True,
    keep_commits: int | None = None,
) -> BatchResult:
    """Run the whole batch; ``build_report=False`` stops behind the snapshot.
    ``keep_commits`` deletes what only older commits of the published dataset list.

    The snapshot is written, and the roll-up's rounds run, here.  With
    ``publish_to`` the report is published there (created if there is nothing
    yet, else its lookback window is refreshed) and the returned report is read
    from it; without, the returned report is joined and sorted on use.
    """
    joined = joined_inventory(activity_docs, entity_docs)
    d = write_snapshot(joined, snapshot_path, as_of, mode=snapshot_mode)
    if not build_report:
        return BatchResult(None, snapshot_path, d)
    latest = latest_snapshot(spark, snapshot_path)

    def dated(df: DataFrame) -> DataFrame:
        return cast_date(df, "date", "yyy/MM/dd")

    report = tag_geo(dated(rollup_report(latest, sort=sort and publish_to is None)))
    created = None
    if publish_to is not None:
        newest = dated(latest.select("date")).agg(F.max("date")).first()[0]
        created = publish_or_refresh(report, publish_to, "date", as_of=newest)
        if keep_commits is not None:
            vacuum(spark, publish_to, keep_commits)
        report = tag_geo(read_published(spark, publish_to))
        report = sort_report(report) if sort else report
    return BatchResult(report, snapshot_path, d, created)


def secured_report(report: DataFrame, rules_path: str, principal: str) -> DataFrame:
    """The published report as ``principal`` sees it, by the published rules."""
    return apply_rls(report, read_rules_dataset(report.sparkSession, rules_path), principal)


def refresh_rules(spark: SparkSession, rules_path: str, events: DataFrame, admins, prefix: str, tries: int = 3) -> None:
    """After tenant-created events: the rules (M4, M3), then a full refresh of the
    rules dataset (M2).  A missing dataset counts as no rules.

    The refresh is a commit after the very rules it was made from.  If another
    writer's came between, the events are applied anew to the rules it left, so no
    grant is lost.
    """
    for left in range(tries - 1, -1, -1):
        base = newest_commit(spark, rules_path)
        rules = read_rules_dataset(spark, rules_path) if base else spark.createDataFrame([], "UserArn string, tenantid string")
        try:
            return full_refresh(grant(rules, events, admins, prefix), rules_path, base)
        except CommitConflict:
            if not left:
                raise


def read_rules_dataset(spark: SparkSession, rules_path: str) -> DataFrame:
    """The rules dataset as last committed."""
    return read_committed(spark, rules_path)

"""ecotally: a Spark-native emissions-inventory engine.

The main operators, importable from the package root::

    from ecotally import read_snapshots, latest_partition, rollup_report, apply_rls
"""

from .operators.join import join_activity_entity
from .operators.latest import create_latest_view, latest_partition
from .operators.refresh import incremental_refresh, lookback, refresh_published
from .operators.rollup import (
    HierarchyCycleError,
    entity_rollup_report,
    rollup_by_level,
    rollup_contributions,
    rollup_report,
    rollup_totals,
)
from .operators.security import apply_rls, grant, upsert_rules
from .operators.shape import apply_mapping, cast_date, extract_choice, flatten_struct, tag_geo
from .plans.batch import run_batch
from .sources.documents import read_activity, read_documents, read_entity, read_rules
from .sources.snapshot import publish, read_snapshots, write_snapshot

__all__ = [
    "HierarchyCycleError",
    "apply_mapping",
    "apply_rls",
    "cast_date",
    "create_latest_view",
    "entity_rollup_report",
    "extract_choice",
    "flatten_struct",
    "grant",
    "incremental_refresh",
    "join_activity_entity",
    "latest_partition",
    "lookback",
    "publish",
    "read_activity",
    "read_documents",
    "read_entity",
    "read_rules",
    "read_snapshots",
    "refresh_published",
    "rollup_by_level",
    "rollup_contributions",
    "rollup_report",
    "rollup_totals",
    "run_batch",
    "tag_geo",
    "upsert_rules",
    "write_snapshot",
]

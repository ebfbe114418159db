"""J1 (+P6): activity rows joined to their entity.

Inner equi-join on two keys named differently on each side; NULL keys never
match; the right-hand keys are dropped.  Spark broadcasts the entity side when
its measured bytes allow (the activity side is then not shuffled); beyond that
it is a shuffle join whose skewed partitions AQE splits.  Each side is read
once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIVITY_KEYS = ("entityid", "tenantid")
ENTITY_KEYS = ("entity_id", "tenant_id")


def join_activity_entity(
    activity: DataFrame,
    entity: DataFrame,
    left_keys: tuple[str, ...] = ACTIVITY_KEYS,
    right_keys: tuple[str, ...] = ENTITY_KEYS,
    on_collision: str = "raise",
) -> DataFrame:
    """``activity ⋈ entity`` on ``left_keys = right_keys``; right keys dropped.

    Non-key columns present on both sides (H5) raise by default;
    ``on_collision="prefix"`` renames the entity's copies to ``entity_<name>``.
    """
    right_key_set = {k.lower() for k in right_keys}
    left_names = {c.lower() for c in activity.columns}
    clashes = [
        c for c in entity.columns
        if c.lower() in left_names and c.lower() not in right_key_set
    ]
    if clashes:
        if on_collision == "raise":
            raise ValueError(f"columns on both sides of the join: {clashes}")
        if on_collision != "prefix":
            raise ValueError(f"unknown on_collision {on_collision!r}")
        entity = entity.select(
            *[
                F.col(f"`{c}`").alias(f"entity_{c}") if c in clashes else F.col(f"`{c}`")
                for c in entity.columns
            ]
        )
    a = activity.alias("a")
    e = entity.alias("e")
    cond = None
    for lk, rk in zip(left_keys, right_keys):
        term = F.col(f"a.{lk}") == F.col(f"e.{rk}")
        cond = term if cond is None else cond & term
    joined = a.join(e, cond, "inner")
    keep = [F.col(f"a.`{c}`") for c in activity.columns] + [
        F.col(f"e.`{c}`") for c in entity.columns if c not in right_keys
    ]
    return joined.select(*keep)

"""Hierarchical contribution roll-up (R1), totals (A1), total attach (J3),
report ordering (O1) and the composite report (R2).

Semantics (``mode="reference"``), for every row ``v`` of the latest view V:

* anchor, level 0: ``id = root = v.entity``,
  ``loc = COALESCE(total, location, 0)``, ``mkt = COALESCE(total, market, 0)``,
  ``p = v.percentage``;
* step: for a contribution ``c`` and **every row** ``t`` of V with
  ``t.entity = c.id`` and ``t.tenant = c.tenant`` emit
  ``id = t.parent, loc = dec(c.loc * c.p), mkt = dec(c.mkt * c.p)``, keeping
  root, tenant and the root's own ``p`` (``dec`` = cast to DECIMAL(20,10));
* totals: sum per ``id`` (tenants mixed), attached to V rows on ``entity = id``.

How it runs on Spark, the same way at every size and depth:

1. ``edge_table``: V collapsed to ``(tenant, entity, parent) -> mult`` (rows).
   Map-side partial aggregation makes a hot entity cheap.
2. ``hierarchy``: four jumps of one step make one of four steps, four of those one of
   sixteen, and so on: as many written rounds as the depth has digits to the base 4.
   Those who can jump get fewer by the round, unless there is a cycle.  With the
   jumps come the heights, the most steps each entity can climb.
3. ``level_sums``: each V row's amounts at the levels (the rounded chain
   ``dec(dec(x*p)*p)...``), ``BLOCK`` levels in one projection, summed per entity
   side by side.  Rounding depends on the row alone, so summing here is exact.
4. ``_folded``: a sum of level n climbs by the jumps that n's digits name, joins and
   an aggregate a digit, all in one plan; what meets is added up.

Rounds, and level sums of several passes, are written to the shared scratch folder and
read back: a plan grows with the logarithm of the depth, and a lost executor costs one
round.  Amounts are summed as unscaled integers of up to 38 digits: the number of
paths has no limit of its own, and a total beyond DECIMAL(30,10) raises, with ANSI
mode on or off, as does an amount beyond DECIMAL(20,10) at a level that is reached.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.expressions import (
    AMOUNT_TYPE,
    TOTAL_TYPE,
    coalesce_amount,
)
from ..session import delete_path, scratch_path

_WHOLE = "decimal(38,0)"  # unscaled amounts and path counts
_UNIT = 10**10  # scale of amounts and totals
_AMOUNT_SUM = "decimal(30,10)"


class HierarchyCycleError(RuntimeError):
    """Raised when an entity is its own ancestor (the recursion would not end),
    or when the hierarchy is deeper than asked for."""


@dataclass(frozen=True)
class HierarchyColumns:
    """Column names of the roll-up input (defaults: the latest snapshot)."""

    entity: str = "entityid"
    tenant: str = "tenantid"
    parent: str = "parententityid"
    total: str = "emissioninkgco2"
    location: str = "emissioninkgco2_forlocationbased"
    market: str = "emissioninkgco2_formarketbased"
    percentage: str = "parentcontributionpercentage"


DEFAULT_COLUMNS = HierarchyColumns()


def _unscaled(amount: str) -> Column:
    """A DECIMAL(30,10) as the integer of its 10**-10 parts, exactly."""
    whole = F.floor(F.col(amount)).cast(_WHOLE)
    rest = ((F.col(amount) - F.floor(F.col(amount))) * F.lit(_UNIT).cast("decimal(11,0)")).cast(_WHOLE)
    return whole * F.lit(_UNIT).cast("decimal(11,0)").cast(_WHOLE) + rest


def _total(unscaled: Column) -> Column:
    """The inverse of ``_unscaled`` as TOTAL_TYPE; raises beyond it."""
    unit = F.lit(_UNIT).cast("decimal(11,0)")
    rest = unscaled % unit
    whole = ((unscaled - rest) / unit).cast("decimal(38,6)").cast("decimal(28,0)")
    value = (whole.cast("decimal(28,10)") + (rest.cast("decimal(11,0)") * F.lit("0.0000000001").cast("decimal(10,10)"))).cast(TOTAL_TYPE)
    return F.when(
        value.isNull() & unscaled.isNotNull(), F.raise_error(F.lit("roll-up total beyond DECIMAL(30,10)")).cast(TOTAL_TYPE)
    ).otherwise(value)


class _Rounds:
    """Numbered parts of one table on the shared scratch folder."""

    def __init__(self, spark, name: str):
        self.spark = spark
        self.path = scratch_path(spark, name)
        self.schema = None

    def write(self, k: int, df: DataFrame) -> DataFrame:
        """Write part ``k`` and read it back."""
        df.write.parquet(f"{self.path}/part={k}")
        self.schema = df.schema
        return self.part(k)

    def part(self, k: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/part={k}")

    def write_observed(self, k: int, df: DataFrame, *metrics: Column) -> tuple[DataFrame, dict]:
        """``write``, with metrics of the rows observed while they were written."""
        seen = Observation()
        part = self.write(k, df.observe(seen, *metrics))
        return part, seen.get

    def whole(self) -> DataFrame:
        """All parts in one scan."""
        return self.spark.read.schema(self.schema).parquet(self.path).select(*self.schema.names)

    def drop(self, k: int) -> None:
        delete_path(self.spark, f"{self.path}/part={k}")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def edge_table(v: DataFrame, cols: HierarchyColumns = DEFAULT_COLUMNS) -> DataFrame:
    """``(tenantid, entityid, parententityid, mult)``: one step of the recursion.

    ``mult`` counts the V rows behind an edge — the reference step joins
    activity rows, so an entity with k rows multiplies what passes through it.
    """
    return v.groupBy(
        F.col(cols.tenant).alias("tenantid"),
        F.col(cols.entity).alias("entityid"),
        F.col(cols.parent).alias("parententityid"),
    ).agg(F.count(F.lit(1)).alias("mult"))


# ---------------------------------------------------------------- hierarchy
#: Steps of a longer jump, in jumps of the kind before it.
FAN = 4
#: With several parents an entity, jump tables are multiplied as long as the next one
#: has at most so many times the edges.
MOST_JUMPS = 2


@dataclass
class Hierarchy:
    """How far the entities with tenant can climb (the step to a parent without
    rows, or to NULL, included), and the jumps to climb by.

    A jump table holds ``(tenantid, entityid, above, paths)``: who is reached by how
    many paths of exactly ``fan ** k`` steps; ``paths`` is NULL beyond 38 digits.
    """

    jumps: list[DataFrame]
    fan: int
    stride: DataFrame | None  # the longest jumps, where no longer ones were built
    climbs: DataFrame  # tenantid, entityid, height >= 1 (and ps, the percentages on the way)
    depth: int  # greatest height


def _cycle(n) -> HierarchyCycleError:
    return HierarchyCycleError(f"{n} entities on or below a cycle")


def _too_deep(max_depth: int) -> HierarchyCycleError:
    return HierarchyCycleError(f"hierarchy deeper than max_depth={max_depth}")


def hierarchy(edges: DataFrame, max_depth: int | None = None) -> Hierarchy:
    """Jumps and heights of the edges (tenantid, entityid, parententityid, mult), which
    may repeat, in a number of written rounds that grows with the logarithm of the
    depth.

    Raises ``HierarchyCycleError`` on a cycle, and where an entity can climb more
    than ``max_depth`` steps.  With a column ``percentage`` (one parent an entity),
    ``climbs`` gets the percentages on the way up as the array ``ps``.
    """
    spark = edges.sparkSession
    rounds = _Rounds(spark, "climbs")
    share = ", array(min(percentage)) AS ps" if "percentage" in edges.columns else ""
    first, seen = rounds.write_observed(0, spark.sql(
        f"""SELECT tenantid, entityid, min(parententityid) AS above, 1 AS height, CAST(sum(mult) AS {_WHOLE}) AS paths,
              min(parententityid) <=> max(parententityid) AND count(parententityid) IN (0, count(*)) AS one_parent{share}
            FROM {{edges}} WHERE tenantid IS NOT NULL AND entityid IS NOT NULL GROUP BY tenantid, entityid""", edges=edges,
    ), F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("one_parent")).alias("several"))
    if seen["several"]:
        return _of_graph(edges, seen["rows"], max_depth)
    return _of_forest(rounds, first.drop("one_parent"), seen["rows"], max_depth)


def _of_forest(rounds: _Rounds, reach: DataFrame, count: int, max_depth: int | None) -> Hierarchy:
    """Every entity has one row: how far its known way up goes, and to whom.  A round
    hands those whose way is still open (as long as a jump) on to the ways of whom
    they reach, ``FAN`` - 1 times, which makes the jumps ``FAN`` times as long.
    There are fewer open ways each round unless there is a cycle.
    """
    jumps, steps, depth = [], 1, 1 if count else 0
    while count:
        if max_depth is not None and steps > max_depth:
            raise _too_deep(max_depth)
        jumps.append(reach.filter(F.col("height") == steps).select("tenantid", "entityid", "above", "paths"))
        columns, joins, height = [f"{c}" for c in reach.columns if c in ("ps",)], "", "a.height"
        above, paths, ps = "a.above", "a.paths", "a.ps"
        for k in range(1, FAN):
            b = f"b{k}"
            joins += f" LEFT JOIN {{reach}} {b} ON a.tenantid = {b}.tenantid AND {above} = {b}.entityid AND {height} = {k * steps}"
            met = f"{b}.height IS NOT NULL"
            above, paths = f"if({met}, {b}.above, {above})", f"if({met}, try_multiply({paths}, {b}.paths), {paths})"
            height, ps = f"({height} + coalesce({b}.height, 0))", f"if({met}, concat({ps}, {b}.ps), {ps})"
        steps *= FAN
        reach, seen = rounds.write_observed(len(jumps), reach.sparkSession.sql(
            f"SELECT a.tenantid, a.entityid, {above} AS above, {height} AS height, {paths} AS paths"
            f"{f', {ps} AS ps' if columns else ''} FROM {{reach}} a{joins}", reach=reach,
        ), F.count_if(F.col("height") == steps).alias("open"), F.max("height").alias("top"))
        if seen["open"] == count:
            raise _cycle(count)
        count, depth = seen["open"], seen["top"]
    if max_depth is not None and depth > max_depth:
        raise _too_deep(max_depth)
    return Hierarchy(jumps, FAN, None, reach.drop("above", "paths"), depth)


def _of_graph(edges: DataFrame, count: int, max_depth: int | None) -> Hierarchy:
    """Entities with several parents: a jump table joined with itself, paths that meet
    added up, gives jumps of twice as many steps, until nobody can jump so far.

    Such a table could hold many pairs: it is built only if the join makes at most
    ``MOST_JUMPS`` times the edges, else the last jumps are taken one by one.
    """
    spark = edges.sparkSession
    rounds = _Rounds(spark, "jumps")
    jump, seen = rounds.write_observed(0, spark.sql(
        f"""SELECT tenantid, entityid, parententityid AS above, CAST(sum(mult) AS {_WHOLE}) AS paths
            FROM {{edges}} WHERE tenantid IS NOT NULL AND entityid IS NOT NULL GROUP BY ALL""", edges=edges,
    ), F.count(F.lit(1)).alias("rows"))
    jumps, stride, rows = [], None, seen["rows"]
    while count:
        if max_depth is not None and 1 << len(jumps) > max_depth:
            raise _too_deep(max_depth)
        if _joined_rows(jump) > MOST_JUMPS * rows:
            stride = jump
            break
        jumps.append(jump)
        jump = rounds.write(len(jumps), spark.sql(
            f"""SELECT a.tenantid, a.entityid, b.above, {_PATHS.format("try_multiply(a.paths, b.paths)")} AS paths
                FROM {{jump}} a JOIN {{jump}} b ON a.tenantid = b.tenantid AND a.above = b.entityid GROUP BY a.tenantid, a.entityid, b.above""",
            jump=jump,
        ))
        left = jump.select("tenantid", "entityid").distinct().count()
        if left == count:
            raise _cycle(left)
        count = left
    climbs, depth = _heights(rounds.part(0), jumps, stride)
    if max_depth is not None and depth > max_depth:
        raise _too_deep(max_depth)
    return Hierarchy(jumps, 2, stride, climbs, depth)


#: Sum of path counts; NULL, as a count beyond 38 digits is, if one of them is.
_PATHS = f"CAST(CASE WHEN count({{0}}) = count(*) THEN try_sum({{0}}) END AS {_WHOLE})"


def _joined_rows(jump: DataFrame) -> int:
    """Rows that a jump table makes when joined with itself, from the degrees alone."""
    return jump.sparkSession.sql(
        f"""SELECT coalesce(sum(CAST(a.n * b.n AS {_WHOLE})), 0) FROM (SELECT tenantid, above, count(*) AS n FROM {{jump}} GROUP BY ALL) a
            JOIN (SELECT tenantid, entityid, count(*) AS n FROM {{jump}} GROUP BY ALL) b ON a.tenantid = b.tenantid AND a.above = b.entityid""",
        jump=jump,
    ).first()[0]


def _raised(climbs: DataFrame, jump: DataFrame, steps: int) -> DataFrame:
    """Heights cut off at c, by jumps of ``steps`` >= c steps: heights cut off at c + ``steps``.
    Each height stays, and is handed down to those who jump to it."""
    return climbs.sparkSession.sql(
        f"""SELECT tenantid, entityid, max(height) AS height FROM (
              SELECT c.tenantid, if(c.take = 1, j.entityid, c.entityid) AS entityid, c.height + c.take * {steps} AS height
              FROM (SELECT *, explode(array(0, 1)) AS take FROM {{climbs}}) c
              LEFT JOIN {{jump}} j ON c.tenantid = j.tenantid AND c.entityid = j.above AND c.take = 1
              WHERE c.take = 0 OR j.entityid IS NOT NULL
              UNION ALL SELECT tenantid, entityid, {steps} FROM {{jump}}) GROUP BY tenantid, entityid""",
        climbs=climbs, jump=jump,
    )


def _heights(edges: DataFrame, jumps: list[DataFrame], stride: DataFrame | None) -> tuple[DataFrame, int]:
    """Heights from the jumps, shortest ones first: one plan, a join and an aggregate
    a jump table.  Beyond them a round for each stride."""
    rounds = _Rounds(edges.sparkSession, "heights")
    climbs = edges.select("tenantid", "entityid", F.lit(1).alias("height")).distinct()
    if not jumps:
        climbs = climbs.withColumn("height", F.lit(0)).limit(0)
    for k, jump in enumerate(jumps[1:], 1):
        climbs = _raised(climbs, jump, 1 << k)
    unit = 1 << len(jumps)
    top = F.max("height").alias("top")
    climbs, seen = rounds.write_observed(0, climbs, top)
    most, k, at_top = seen["top"] or 0, 0, None
    while stride is not None:
        # heights are cut off at unit * (k + 1) - 1 so far
        k, limit = k + 1, unit * (k + 2) - 1
        climbs, seen = rounds.write_observed(k, _raised(climbs, stride, unit), top, F.count_if(F.col("height") >= limit).alias("limited"))
        rounds.drop(k - 1)
        most = seen["top"]
        if most < limit:
            break
        if seen["limited"] == at_top:
            raise _cycle(at_top)
        at_top = seen["limited"]
    return climbs, most


# ------------------------------------------------------------------ folding
def _guarded_sql(value: str, given: str) -> str:
    """``value``, or an error where it is NULL although ``given`` says it cannot be (an
    overflow, which is silent without ANSI mode)."""
    return f"coalesce({value}, CASE WHEN {given} THEN CAST(raise_error('roll-up amount beyond 38 digits') AS {_WHOLE}) END)"


def _times(amount: str, paths: str) -> str:
    """An amount as often as there are paths; no number of paths is too many for 0."""
    product = f"CAST(if({amount} = 0, 0, try_multiply({amount}, {paths})) AS {_WHOLE})"
    return _guarded_sql(product, f"{amount} IS NOT NULL")


def _added(amount: str) -> str:
    return _guarded_sql(f"CAST(sum({amount}) AS {_WHOLE})", f"count({amount}) > 0")


def _measures(*amounts: str) -> str:
    """Aggregates of amounts that take the paths of a step."""
    return ", ".join(f"{_added(_times(a, '{paths}'))} AS {a}" for a in amounts)


def _climbed(source: str, jump: str, hops: int, measure: str, keep: list[str], taken: str, after: str, how: str) -> str:
    """SQL: rows of ``source`` take ``taken`` jumps, at most ``hops``, and equal
    (tenantid, entityid, level, ``keep``) are added up; rows without so many go."""
    joins, at, gone = "", "s.entityid", []
    for k in range(1, hops + 1):
        joins += f" {how} JOIN {{{jump}}} j{k} ON s.tenantid = j{k}.tenantid AND {at} = j{k}.entityid AND {taken} >= {k}"
        gone.append(f"({taken} < {k} OR j{k}.entityid IS NOT NULL)")
        at = f"j{k}.above"
    place, paths, product = "CASE", "CASE", f"CAST(1 AS {_WHOLE})"
    for k in range(hops + 1):
        product = f"try_multiply({product}, j{k}.paths)" if k > 1 else f"j{k}.paths" if k else product
        when = f" WHEN {taken} = {k} THEN"
        place, paths = f"{place}{when} {f'j{k}.above' if k else 's.entityid'}", f"{paths}{when} {product}"
    kept = "".join(f", s.{c}" for c in keep)
    inner = f"SELECT s.* EXCEPT (entityid, level), {place} END AS entityid, {paths} END AS taken_paths, {after} AS level FROM {source} s{joins} WHERE {' AND '.join(gone)}"
    return (
        f"(SELECT tenantid, entityid, level{kept.replace('s.', '')}, {measure.replace('{paths}', 'taken_paths')}"
        f" FROM ({inner}) GROUP BY tenantid, entityid, level{kept.replace('s.', '')})"
    )


def _folded(s: DataFrame, found: Hierarchy, measure: str, keep: list[str] = ()) -> DataFrame:
    """Move every row (tenantid, entityid, level, ...) up by ``level`` steps, along all
    paths, and add up what meets.

    The digits of the level to the base ``fan`` say how many jumps of which length,
    shortest first: joins and an aggregate a digit, all in one plan.  ``measure``
    are the aggregates of a step; ``keep`` are further grouping columns.
    """
    keep, text, frames = list(keep), "{s}", {"s": s}
    for k, jump in enumerate(found.jumps):
        frames[f"jump{k}"] = jump
        text = _climbed(text, f"jump{k}", found.fan - 1, measure, keep, f"s.level % {found.fan}", f"CAST(s.level div {found.fan} AS int)", "LEFT")
    if found.jumps:
        s = s.sparkSession.sql(f"SELECT * FROM {text}", **frames)
    if found.stride is None:
        return s.drop("level")
    # strides: what is left climbs from the top level down, a written round each
    s = _written(s, "strides")
    rounds = _Rounds(s.sparkSession, "strides")
    most = found.depth // found.fan ** len(found.jumps)
    gathered = s.filter(F.col("level") == most)
    for k in range(most, 0, -1):
        text = _climbed("{gathered}", "jump", 1, measure, keep, "1", str(k - 1), "INNER")
        moved = s.sparkSession.sql(f"SELECT * FROM {text}", gathered=gathered, jump=found.stride)
        once, by = measure.replace("{paths}", f"CAST(1 AS {_WHOLE})"), ", ".join(["tenantid", "entityid", "level", *keep])
        meet = moved.unionByName(s.filter(F.col("level") == k - 1))
        gathered = rounds.write(k - 1, s.sparkSession.sql(f"SELECT {by}, {once} FROM {{meet}} GROUP BY {by}", meet=meet))
        if k < most:
            rounds.drop(k)
    return gathered.drop("level")


def ancestor_closure(found: Hierarchy) -> DataFrame:
    """``(tenantid, rootid, ancestorid, paths, distance)`` for the distances 1 to each
    root's height; ``paths`` is NULL beyond 38 digits."""
    start = found.climbs.selectExpr(
        "tenantid", "entityid", "entityid AS rootid", "explode(sequence(1, height)) AS distance", f"CAST(1 AS {_WHOLE}) AS paths"
    ).withColumn("level", F.col("distance"))
    paths = f"{_PATHS.replace('{0}', 'try_multiply(paths, {paths})')} AS paths"
    return _folded(start, found, paths, ["rootid", "distance"]).select(
        "tenantid", "rootid", F.col("entityid").alias("ancestorid"), "paths", "distance"
    )


# ------------------------------------------------------------ level amounts
#: Levels of amounts that one pass over the rows makes.
BLOCK = 16


def _chains(rows: DataFrame, found: Hierarchy, percentage, carry: list[str]):
    """Pass by pass (first level, number of levels, rows with the amounts l0, m0,
    l1, ... from that level on, and ``over``, the first of these levels beyond their
    type).

    A pass is one projection; only rows whose entity climbs beyond its levels go on
    to the next one, with their last amounts.  ``percentage`` gives the factor of a
    step as SQL.
    """
    start, amount = 0, AMOUNT_TYPE.simpleString()
    while True:
        count = min(BLOCK, found.depth + 1 - start)
        steps, lost = "", ""
        for k in range(1, count + 1):
            p = percentage(start + k)
            steps += "".join(f", try_cast({c}{k - 1} * {p} AS {amount}) AS {c}{k}" for c in "lm")
            lost += f" WHEN {p} IS NOT NULL AND (l{k} IS NULL AND l{k - 1} IS NOT NULL OR m{k} IS NULL AND m{k - 1} IS NOT NULL) THEN {start + k}"
        # a column may use those before it
        wide = rows.sparkSession.sql(f"SELECT *{steps}, CAST(CASE{lost} END AS int) AS over FROM {{rows}}", rows=rows)
        yield start, count, wide
        start += count
        if start > found.depth:
            return
        deep = found.climbs.filter(F.col("height") >= start).select("tenantid", "entityid")
        rows = _written(
            wide.join(deep, ["tenantid", "entityid"], "left_semi")
            .select("tenantid", "entityid", *carry, F.col(f"l{count}").alias("l0"), F.col(f"m{count}").alias("m0")),
            "frontier",
        )


def _unrolled(rows: DataFrame, found: Hierarchy, start: int, count: int, keep: list[str]) -> DataFrame:
    """Rows with amounts side by side as rows with a level each, as far up as the
    row's own entity climbs."""
    entries = ", ".join(f"struct({start + k} AS level, l{k} AS loc, m{k} AS mkt)" for k in range(count))
    kept = "".join(f", r.{c}" for c in keep)
    return rows.sparkSession.sql(
        f"""SELECT r.tenantid, r.entityid{kept}, inline(slice(array({entries}), 1,
              CASE WHEN over <= coalesce(height, 0) THEN CAST(raise_error('roll-up amount beyond {AMOUNT_TYPE.simpleString()}') AS int)
                   ELSE least({count}, coalesce(height, 0) - {start - 1}) END))
            FROM {{rows}} r LEFT JOIN {{climbs}} c ON r.tenantid = c.tenantid AND r.entityid = c.entityid""",
        rows=rows, climbs=found.climbs.select("tenantid", "entityid", "height"),
    )


def _anchored(v: DataFrame, cols: HierarchyColumns) -> DataFrame:
    return v.select(
        F.col(cols.tenant).alias("tenantid"), F.col(cols.entity).alias("entityid"), F.col(cols.percentage).alias("percentage"),
        coalesce_amount(cols.total, cols.location).alias("l0"), coalesce_amount(cols.total, cols.market).alias("m0"),
    )


def _own_percentage(_: int) -> str:
    return "percentage"


def level_amounts(v: DataFrame, found: Hierarchy, cols: HierarchyColumns = DEFAULT_COLUMNS) -> DataFrame:
    """The amounts of V's rows at the levels 0 to their own entity's height.

    Output: tenantid, entityid, percentage, rows (how many V rows), level, loc, mkt.
    """
    rows = _anchored(v, cols).groupBy("tenantid", "entityid", "percentage", "l0", "m0").agg(F.count(F.lit(1)).alias("rows"))
    carry = ["percentage", "rows"]
    out = None
    for start, count, wide in _chains(rows, found, _own_percentage, carry):
        part = _unrolled(wide, found, start, count, carry)
        out = part if out is None else out.unionByName(part)
    return out


def _summed(rows: DataFrame, found: Hierarchy, percentage, carry: list[str]) -> DataFrame:
    """Unscaled sums and row counts per (tenantid, entityid, level) of rows with l0 and
    m0; written where it takes several passes.

    The levels are added up side by side, so an activity row enters one partial
    aggregate whatever its depth; they become rows at entity grain.
    """
    rounds = _Rounds(rows.sparkSession, "levels")
    unscaled = {"loc": _unscaled("loc"), "mkt": _unscaled("mkt")}
    for k, (start, count, wide) in enumerate(_chains(rows, found, percentage, carry)):
        sums = ", ".join(f"CAST(sum({c}{i}) AS {_AMOUNT_SUM}) AS {c}{i}" for i in range(count) for c in "lm")
        sums = wide.sparkSession.sql(f"SELECT tenantid, entityid, count(*) AS rows, min(over) AS over, {sums} FROM {{wide}} GROUP BY ALL", wide=wide)
        long = _unrolled(sums, found, start, count, ["rows"]).withColumns(unscaled)
        if found.depth < BLOCK:
            return long
        rounds.write(k, long)
    return rounds.whole()


def level_sums(v: DataFrame, found: Hierarchy, cols: HierarchyColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Unscaled sums and row counts per (tenantid, entityid, level)."""
    return _summed(_anchored(v, cols), found, _own_percentage, ["percentage"])


# ------------------------------------------------------------------ results
def _found(v: DataFrame, cols: HierarchyColumns, max_depth: int | None) -> Hierarchy:
    rows = v.select(
        F.col(cols.tenant).alias("tenantid"), F.col(cols.entity).alias("entityid"), F.col(cols.parent).alias("parententityid"),
        F.lit(1).cast("long").alias("mult"),
    )
    return hierarchy(rows, max_depth)


def _totals(levels: DataFrame, *by: Column) -> DataFrame:
    return levels.groupBy(*by).agg(
        _total(F.expr(_added("loc"))).alias("cumulative_locationbased"), _total(F.expr(_added("mkt"))).alias("cumulative_marketbased")
    )


def rollup_totals(
    v: DataFrame, cols: HierarchyColumns = DEFAULT_COLUMNS, *, max_depth: int | None = None
) -> DataFrame:
    """A1: ``id, cumulative_locationbased, cumulative_marketbased`` (NULL id kept)."""
    found = _found(v, cols, max_depth)
    climbed = _folded(level_sums(v, found, cols).drop("rows"), found, _measures("loc", "mkt"))
    return _totals(climbed, F.col("entityid").alias("id"))


def rollup_by_level(
    v: DataFrame, cols: HierarchyColumns = DEFAULT_COLUMNS, *, max_depth: int | None = None
) -> DataFrame:
    """Contributions grouped by (id, level): id, level, amount_locationbased,
    amount_marketbased, n (DECIMAL(38,0): a path count has no limit of its own, and
    one beyond 38 digits raises)."""
    found = _found(v, cols, max_depth)
    sums = level_sums(v, found, cols).withColumns({"rows": F.col("rows").cast(_WHOLE), "climbed": F.col("level")})
    return _folded(sums, found, _measures("loc", "mkt", "rows"), ["climbed"]).groupBy(
        F.col("entityid").alias("id"), F.col("climbed").alias("level")
    ).agg(
        _total(F.expr(_added("loc"))).alias("amount_locationbased"), _total(F.expr(_added("mkt"))).alias("amount_marketbased"),
        F.expr(_added("rows")).alias("n"),
    )


def rollup_contributions(
    v: DataFrame, cols: HierarchyColumns = DEFAULT_COLUMNS, *, max_depth: int | None = None
) -> DataFrame:
    """R1 in grouped form: one row per distinct contribution with its count.

    Columns: id, tenantid, rootid, amount_locationbased, amount_marketbased,
    percentage, level, n (DECIMAL(38,0), as in ``rollup_by_level``).
    """
    found = _found(v, cols, max_depth)
    detail = _written(
        level_amounts(v, found, cols)
        .groupBy("tenantid", "entityid", "level", "percentage", "loc", "mkt").agg(F.sum("rows").cast(_WHOLE).alias("rows")),
        "levels",
    )
    return v.sparkSession.sql(
        f"""SELECT id, tenantid, entityid AS rootid, loc AS amount_locationbased, mkt AS amount_marketbased, percentage, level,
              {_times("rows", "paths")} AS n
            FROM (SELECT *, entityid AS id, CAST(1 AS {_WHOLE}) AS paths FROM {{detail}} WHERE level = 0
                  UNION ALL
                  SELECT d.*, c.ancestorid, c.paths FROM {{detail}} d
                  JOIN {{closure}} c ON d.tenantid = c.tenantid AND d.entityid = c.rootid AND d.level = c.distance)""",
        detail=detail, closure=ancestor_closure(found),
    )


def attach_totals(v: DataFrame, totals: DataFrame, cols: HierarchyColumns = DEFAULT_COLUMNS) -> DataFrame:
    """``T.*`` plus totals (market first, then location), joined on id only.

    Totals are entity-grain: Spark broadcasts them by their measured size, else
    AQE splits the partitions of a hot entity.
    """
    t = totals.filter(F.col("id").isNotNull()).select(
        F.col("id").alias("__total_id"),
        F.col("cumulative_marketbased").alias("total_emissions_marketbased"),
        F.col("cumulative_locationbased").alias("total_emissions_locationbased"),
    )
    return v.join(t, F.col(cols.entity) == F.col("__total_id"), "inner").drop("__total_id")


def sort_report(
    report: DataFrame,
    cols: HierarchyColumns = DEFAULT_COLUMNS,
    tiebreak: list[str] | None = None,
) -> DataFrame:
    """O1: ``ORDER BY entity, parent`` (ascending, NULLs last).

    The remaining columns are appended as tie-breakers: it leaves the required
    order intact but lets the range partitioner split one hot entity over many
    partitions instead of sorting it in a single task.
    """
    if tiebreak is None:
        tiebreak = [c for c in report.columns if c not in (cols.entity, cols.parent)]
    keys = [cols.entity, cols.parent, *tiebreak]
    return report.orderBy(*[F.col(c).asc_nulls_last() for c in keys])


def rollup_report(
    v: DataFrame, cols: HierarchyColumns = DEFAULT_COLUMNS, *, sort: bool = True, max_depth: int | None = None
) -> DataFrame:
    """R2 (flagship): roll-up -> totals -> attach -> order.

    The totals are written before they are attached, so the sort's sampling
    pass reads them again instead of adding them up again.
    """
    totals = _written(rollup_totals(v, cols, max_depth=max_depth), "totals")
    report = attach_totals(v, totals, cols)
    return sort_report(report, cols) if sort else report


# --------------------------------------------------------------- entity mode
def entity_table(v: DataFrame, cols: HierarchyColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Distinct ``(tenantid, entityid, parententityid, percentage)`` of V."""
    return v.select(
        F.col(cols.tenant).alias("tenantid"),
        F.col(cols.entity).alias("entityid"),
        F.col(cols.parent).alias("parententityid"),
        F.col(cols.percentage).alias("percentage"),
    ).distinct()


def entity_rollup_totals(
    v: DataFrame,
    entities: DataFrame | None = None,
    cols: HierarchyColumns = DEFAULT_COLUMNS,
    *,
    max_depth: int | None = None,
) -> DataFrame:
    """Totals with the reference's quirks fixed (``mode="entity"``).

    One edge per (tenant, entity) from ``entities`` (default: V's distinct
    entity rows), so activity rows do not multiply what passes through (Q1);
    each step applies the percentage of the entity it leaves (Q2); totals are
    per ``(tenantid, id)`` (Q3); the climb goes through the entity table, so
    parents without activity rows pass contributions on (Q5).  Rounding per
    step and NULL percentages behave as in the reference.

    Plan: the rounds that make the jumps gather every entity's percentages on its
    way up as an array; per V row the chain of rounded amounts over that array;
    sums per (tenant, entity, level), which climb as in the reference mode.
    """
    ent = _written(
        (entity_table(v, cols) if entities is None else entities).select(
            "tenantid", "entityid", "parententityid", "percentage"
        ),
        "entities",
    )
    dup = ent.groupBy("tenantid", "entityid").count().filter("count > 1").limit(1)
    if not dup.isEmpty():
        raise ValueError("entity mode needs one parent and percentage per (tenant, entity)")
    found = hierarchy(ent.withColumn("mult", F.lit(1).cast("long")), max_depth)
    rows = _anchored(v, cols).drop("percentage").join(found.climbs.select("tenantid", "entityid", "ps"), ["tenantid", "entityid"], "left")
    sums = _summed(rows, found, lambda k: f"get(ps, {k - 1})", ["ps"]).drop("rows")
    return _totals(_folded(sums, found, _measures("loc", "mkt")), F.col("tenantid"), F.col("entityid").alias("id"))


def entity_rollup_report(
    v: DataFrame,
    entities: DataFrame | None = None,
    cols: HierarchyColumns = DEFAULT_COLUMNS,
    *,
    sort: bool = True,
    max_depth: int | None = None,
) -> DataFrame:
    """R2 with ``mode="entity"``: totals attached on (tenant, entity)."""
    totals = _written(entity_rollup_totals(v, entities, cols, max_depth=max_depth), "totals")
    totals = totals.filter(F.col("id").isNotNull()).select(
        F.col("tenantid").alias("__total_tenant"),
        F.col("id").alias("__total_id"),
        F.col("cumulative_marketbased").alias("total_emissions_marketbased"),
        F.col("cumulative_locationbased").alias("total_emissions_locationbased"),
    )
    report = v.join(
        totals,
        (F.col(cols.tenant) == F.col("__total_tenant")) & (F.col(cols.entity) == F.col("__total_id")),
        "inner",
    ).drop("__total_tenant", "__total_id")
    return sort_report(report, cols) if sort else report


__all__ = [
    "AMOUNT_TYPE",
    "DEFAULT_COLUMNS",
    "Hierarchy",
    "HierarchyColumns",
    "HierarchyCycleError",
    "ancestor_closure",
    "attach_totals",
    "edge_table",
    "entity_rollup_report",
    "entity_rollup_totals",
    "entity_table",
    "hierarchy",
    "level_amounts",
    "level_sums",
    "rollup_by_level",
    "rollup_contributions",
    "rollup_report",
    "rollup_totals",
    "sort_report",
]

"""Roll-up (R1/R2/A1/J3/O1): worked example, oracle equivalence, edge cases."""
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ecotally.operators import rollup
from ecotally.operators.rollup import (
    HierarchyCycleError,
    ancestor_closure,
    edge_table,
    hierarchy,
    level_amounts,
    rollup_by_level,
    rollup_contributions,
    rollup_report,
    rollup_totals,
)

from helpers import duck_recursive_totals, view

# (tenant, entity, parent, total, location, market, percentage)
WORKED = [
    ("t1", "A", None, 10, None, None, 1.00),
    ("t1", "B", "A", 5, None, None, 0.50),
    ("t1", "B", "A", None, 7, 8, 0.50),
    ("t1", "C", "B", 4, None, None, 0.25),
    ("t2", "A", None, 100, None, None, None),
    ("t1", "D", "Z", 3, None, None, 0.5),
]


def totals_of(df):
    return {
        r["id"]: (r["cumulative_locationbased"], r["cumulative_marketbased"])
        for r in df.collect()
    }


def test_worked_example_totals(spark):
    got = totals_of(rollup_totals(view(spark, WORKED)))
    expect = {
        "A": ("122.5", "123.5"),
        "B": ("13", "14"),
        "C": ("4", "4"),
        "D": ("3", "3"),
        "Z": ("1.5", "1.5"),
        None: ("16.125", "16.625"),
    }
    assert set(got) == set(expect)
    for k, (loc, mkt) in expect.items():
        assert got[k] == (Decimal(loc), Decimal(mkt)), k


def test_worked_example_counts(spark):
    by_level = rollup_by_level(view(spark, WORKED)).collect()
    n = {}
    for r in by_level:
        n[r["id"]] = n.get(r["id"], 0) + r["n"]
    assert n == {"A": 8, "B": 3, "C": 1, "D": 1, "Z": 1, None: 8}


def test_worked_example_matches_recursive_sql(spark):
    got = totals_of(rollup_totals(view(spark, WORKED)))
    ref = duck_recursive_totals(WORKED)
    assert {k: (v[0], v[1]) for k, v in ref.items()} == got


def test_report_attaches_totals_and_sorts(spark):
    rep = rollup_report(view(spark, WORKED)).collect()
    # Z and the NULL id have no activity rows: dropped by the inner join.
    assert [r["entityid"] for r in rep] == ["A", "A", "B", "B", "C", "D"]
    first = {r["entityid"]: r for r in rep}
    # tenants mix: both A rows get A's total over t1 and t2
    assert first["A"]["total_emissions_locationbased"] == Decimal("122.5")
    assert first["B"]["total_emissions_marketbased"] == Decimal("14")
    assert rep[0]["total_emissions_marketbased"] == rep[1]["total_emissions_marketbased"]


def test_rounding_every_level(spark):
    # p = 0.33 makes dec(x*p) round below 10 decimals after a few levels.
    rows = [("t", str(i), str(i - 1) if i else None, 1, None, None, 0.33) for i in range(9)]
    got = totals_of(rollup_totals(view(spark, rows)))
    ref = duck_recursive_totals(rows)
    assert {k: (v[0], v[1]) for k, v in ref.items()} == got


def test_contributions_grouped_form(spark):
    rows = rollup_contributions(view(spark, WORKED)).collect()
    total_n = sum(r["n"] for r in rows)
    assert total_n == 8 + 3 + 1 + 1 + 1 + 8 + 0  # every id's contributions
    lvl0 = [r for r in rows if r["level"] == 0]
    assert sum(r["n"] for r in lvl0) == len(WORKED)
    # sum of level-0 amounts equals the anchors' amounts
    assert sum(r["amount_locationbased"] * r["n"] for r in lvl0) == Decimal("129")


def test_cycle_raises(spark):
    rows = [("t", "A", "B", 1, None, None, 0.5), ("t", "B", "A", 1, None, None, 0.5)]
    with pytest.raises(HierarchyCycleError):
        rollup_totals(view(spark, rows)).collect()


def test_no_parents_depth_zero(spark):
    rows = [("t", "A", None, 1, None, None, 0.5), ("t", "B", None, 2, None, None, 0.5)]
    assert hierarchy(edge_table(view(spark, rows))).depth == 1  # one step to the NULL parent
    got = totals_of(rollup_totals(view(spark, rows)))
    assert got["A"] == (Decimal("1"), Decimal("1"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_forests_match_recursive_sql(spark, seed):
    """Property: the climbing form equals the literal recursion (fan-out,
    several tenants, shared entity ids across tenants, NULL amounts/p)."""
    rnd = random.Random(seed)
    rows = []
    for t in ("t1", "t2"):
        n = rnd.randint(5, 14)
        for i in range(n):
            parent = None if i == 0 else str(rnd.randrange(i))
            for _ in range(rnd.randint(1, 3)):
                tot = rnd.choice([None, round(rnd.uniform(0, 100), 2)])
                loc = rnd.choice([None, round(rnd.uniform(0, 50), 3)])
                mkt = rnd.choice([None, round(rnd.uniform(0, 50), 3)])
                p = rnd.choice([None, 0.25, 0.33, 0.5, 0.75, 1.0])
                rows.append((t, str(i), parent, tot, loc, mkt, p))
    got = totals_of(rollup_totals(view(spark, rows)))
    ref = duck_recursive_totals(rows)
    assert {k: (v[0], v[1]) for k, v in ref.items()} == got


def test_closure_holds_every_ancestor(spark):
    parent = {str(i): str(i // 2) if i else None for i in range(40)}
    rows = [("t", e, p, 1, None, None, 0.5) for e, p in parent.items()]
    found = hierarchy(edge_table(view(spark, rows)))
    assert found.depth == 7  # 39-19-9-4-2-1-0 and the NULL step
    expect = set()
    for e in parent:
        at, steps = e, 0
        while at is not None:
            at, steps = parent[at], steps + 1
            expect.add((e, at, steps, 1))
    got = {(r["rootid"], r["ancestorid"], r["distance"], int(r["paths"])) for r in ancestor_closure(found).collect()}
    assert got == expect


def test_max_depth_is_exact(spark):
    rows = [("t", str(i), str(i - 1) if i else None, 1, None, None, 0.5) for i in range(4)]
    edges = edge_table(view(spark, rows))
    assert hierarchy(edges).depth == 4
    assert hierarchy(edges, max_depth=4).depth == 4
    with pytest.raises(HierarchyCycleError):
        hierarchy(edges, max_depth=3)


def test_cycle_of_three_beside_a_tree(spark):
    """Rows repeat, so weights grow by the round; the cycle is still what is reported."""
    rows = [("t", a, b, 1, None, None, 0.5) for a, b in (("A", "B"), ("B", "C"), ("C", "A"))] * 3
    rows += [("t", f"x{i}", f"x{i // 2}" if i else None, 1, None, None, 0.5) for i in range(80)]
    rows += [("t", "below", "A", 1, None, None, 0.5)]
    with pytest.raises(HierarchyCycleError):
        rollup_totals(view(spark, rows)).collect()


def test_paths_beyond_a_billion(spark):
    """1,000 rows an entity on a chain of four: 10**9 paths, amounts 1 each."""
    rows = [("t", str(i), str(i - 1) if i else None, 1, None, None, 0.5) for i in range(4)]
    v = view(spark, rows).crossJoin(spark.range(1000)).drop("id")
    got = totals_of(rollup_totals(v))
    assert got["0"][0] == Decimal(1000) + 500_000 + 250_000_000 + 125_000_000_000
    levels = {(r["id"], r["level"]): r for r in rollup_by_level(v).collect()}
    assert levels[("0", 3)]["n"] == 10**12 and levels[("0", 3)]["amount_locationbased"] == Decimal("125000000000")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_total_beyond_its_type_raises(spark, ansi):
    """Also without ANSI mode, where Spark's own overflow would be a NULL."""
    rows = [("t", str(i), str(i - 1) if i else None, 9_000_000_000, None, None, 1) for i in range(4)]
    v = view(spark, rows).crossJoin(spark.range(1000)).drop("id")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception):
            rollup_totals(v).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_plan_does_not_grow_with_the_depth(spark):
    sizes = []
    for n in (4, 24):
        rows = [("t", str(i), str(i - 1) if i else None, 1, None, None, 0.5) for i in range(n)]
        report = rollup_report(view(spark, rows))
        sizes.append(len(report._jdf.queryExecution().optimizedPlan().toString()))
        assert report.count() == n
    assert sizes[1] < 1.2 * sizes[0]


def test_single_tenant_one_row_per_entity_level_sums(spark):
    rows = [("t", "r", None, 8, None, None, 0.5), ("t", "a", "r", 4, None, None, 0.5),
            ("t", "b", "a", 2, None, None, 0.5)]
    lv = {(r["id"], r["level"]): r["amount_locationbased"] for r in rollup_by_level(view(spark, rows)).collect()}
    assert lv[("r", 0)] == 8 and lv[("r", 1)] == 2 and lv[("r", 2)] == Decimal("0.5")


def test_multi_parent_dag_paths(spark):
    # entity C has rows under two parents: paths merge at the root
    rows = [("t", "R", None, 0, None, None, 1), ("t", "A", "R", 0, None, None, 1),
            ("t", "B", "R", 0, None, None, 1), ("t", "C", "A", 1, None, None, 1),
            ("t", "C", "B", 1, None, None, 1)]
    got = totals_of(rollup_totals(view(spark, rows)))
    ref = duck_recursive_totals(rows)
    assert {k: (v[0], v[1]) for k, v in ref.items()} == got


def random_dag(seed, cycle=False):
    rnd = random.Random(seed)
    rows = []
    for t in ("t1", "t2"):
        for i in range(14):
            for _ in range(rnd.randint(1, 3)):  # a parent of its own for each row
                parent = None if i == 0 or rnd.random() < 0.1 else str(rnd.randrange(max(0, i - 4), i))
                rows.append((t, str(i), parent, rnd.choice([None, 7, 12.5]), 3, None, rnd.choice([None, 0.25, 0.33, 1.0])))
    if cycle:
        rows.append(("t1", "2", "9", 1, None, None, 0.5))
        rows.append(("t1", "9", "2", 1, None, None, 0.5))
    return rows


@pytest.mark.parametrize("most", [0, 1, 100])
def test_random_graphs_match_recursive_sql(spark, monkeypatch, most):
    """Entities with several parents: by strides of one step, of some, and by doubling alone."""
    monkeypatch.setattr(rollup, "MOST_JUMPS", most)
    rows = random_dag(most + 3)
    v = view(spark, rows)
    found = hierarchy(edge_table(v))
    assert (found.stride is not None) == (most < 100) and (most or not found.jumps)
    ref = duck_recursive_totals(rows)
    assert {k: (x[0], x[1]) for k, x in ref.items()} == totals_of(rollup_totals(v))
    n = {}
    for r in rollup_by_level(v).collect():
        n[r["id"]] = n.get(r["id"], 0) + int(r["n"])
    assert n == {k: x[2] for k, x in ref.items()}
    n = {}
    for r in rollup_contributions(v).collect():
        n[r["id"]] = n.get(r["id"], 0) + int(r["n"])
    assert n == {k: x[2] for k, x in ref.items()}


@pytest.mark.parametrize("most", [0, 100])
def test_cycle_in_a_graph_raises(spark, monkeypatch, most):
    monkeypatch.setattr(rollup, "MOST_JUMPS", most)
    with pytest.raises(HierarchyCycleError):
        hierarchy(edge_table(view(spark, random_dag(9, cycle=True))))


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_counts_beyond_a_long_are_exact(spark, ansi):
    """Chain of five entities with 10,000 rows each: 10**20 contributions at the top."""
    rows = [("t", str(i), str(i - 1) if i else None, 0, None, None, 0.5) for i in range(5)]
    v = view(spark, rows).crossJoin(spark.range(10_000)).drop("id")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        by_level = {(r["id"], r["level"]): r["n"] for r in rollup_by_level(v).collect()}
        assert by_level[("0", 4)] == Decimal(10) ** 20 and by_level[(None, 5)] == Decimal(10) ** 24
        each = {(r["id"], r["rootid"], r["level"]): r["n"] for r in rollup_contributions(v).collect()}
        assert each[("0", "4", 4)] == Decimal(10) ** 20 and each[("0", "0", 0)] == 10_000
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_counts_beyond_38_digits_raise_and_zeros_do_not_count(spark, ansi):
    """200 entities with 3 rows: 3**200 paths.  Amounts have long become 0, so totals
    are exact; a count of contributions has no type that holds it."""
    rows = [("t", str(i), str(i - 1) if i else None, 8, None, None, 0.25) for i in range(200) for _ in range(3)]
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        got = totals_of(rollup_totals(view(spark, rows)))
        want, x, k = Decimal(0), Decimal(8), 1
        while x:
            want, x, k = want + x * 3**k, (x * Decimal("0.25")).quantize(Decimal("1e-10"), "ROUND_HALF_UP"), k + 1
        assert got["0"][0] == want
        with pytest.raises(Exception):
            rollup_by_level(view(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_amount_overflow_counts_only_where_it_is_reached(spark, ansi):
    """A share of 50 passes DECIMAL(20,10) in six steps: an entity two steps below the
    top does not get there, one eight steps below does."""
    chain = [("t", str(i), str(i - 1) if i else None, 1, None, None, 0.5) for i in range(9)]
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        low = chain + [("t", "x", "1", 1, None, None, 50)]
        got = totals_of(rollup_totals(view(spark, low)))
        assert {k: (x[0], x[1]) for k, x in duck_recursive_totals(low).items()} == got
        with pytest.raises(Exception, match="beyond"):
            rollup_totals(view(spark, chain + [("t", "x", "8", 1, None, None, 50)])).collect()
        with pytest.raises(Exception, match="beyond"):
            rollup_contributions(view(spark, chain + [("t", "x", "8", 1, None, None, 50)])).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize("depth", [15, 16, 17, 33, 64, 65])
def test_depths_at_the_edges_of_passes_and_jumps(spark, depth):
    rows = [("t", str(i), str(i - 1) if i else None, i + 1, None, None, 0.9) for i in range(depth)]
    rows += [("t", f"s{i}", str(i % depth), 2, None, None, 0.33) for i in range(20)]
    got = totals_of(rollup_totals(view(spark, rows)))
    assert {k: (x[0], x[1]) for k, x in duck_recursive_totals(rows).items()} == got


def test_depth_200_takes_few_rounds_and_a_flat_plan(spark, monkeypatch):
    writes = []
    real = rollup._Rounds.write
    monkeypatch.setattr(rollup._Rounds, "write", lambda self, k, df: writes.append(k) or real(self, k, df))
    plans = []
    for n in (20, 200):
        rows = [("t", str(i), str(i - 1) if i else None, 1, None, None, 0.5) for i in range(n)]
        writes.clear()
        found = hierarchy(edge_table(view(spark, rows)))
        assert found.depth == n and len(found.jumps) <= 4
        totals = rollup_totals(view(spark, rows))
        plans.append(totals._jdf.queryExecution().optimizedPlan().toString().count("Join"))
        assert len(writes) <= 0.5 * n
        assert len(totals_of(totals)) == n + 1
    assert plans[1] <= plans[0] + 3


# ------------------------------------------------------------- entity mode
from ecotally.operators.rollup import entity_rollup_report, entity_rollup_totals  # noqa: E402


def entity_totals_of(df):
    return {(r["tenantid"], r["id"]): (r["cumulative_locationbased"], r["cumulative_marketbased"])
            for r in df.collect()}


def test_entity_mode_uses_each_edge_percentage(spark):
    rows = [("t", "r", None, 1, None, None, 0.5), ("t", "a", "r", 10, None, None, 0.2),
            ("t", "b", "a", 100, None, None, 0.1)]
    got = entity_totals_of(entity_rollup_totals(view(spark, rows)))
    # r: own 1 + a's 10*0.2 + b's (100*0.1)*0.2 (the reference would use 0.1 twice)
    assert got[("t", "r")][0] == Decimal("5")
    assert got[("t", "a")][0] == Decimal("20")
    ref = totals_of(rollup_totals(view(spark, rows)))
    assert ref["r"][0] == Decimal("4")


def test_entity_mode_no_fan_out_and_tenant_aware(spark):
    got = entity_totals_of(entity_rollup_totals(view(spark, [
        ("t1", "A", None, 10, None, None, 1.00),
        ("t1", "B", "A", 5, None, None, 0.50),
        ("t1", "B", "A", None, 7, 8, 0.50),
        ("t2", "A", None, 100, None, None, None),
    ])))
    # B's two rows pass once each: 10 + 2.5 + 3.5; t2's A stays separate
    assert got[("t1", "A")][0] == Decimal("16")
    assert got[("t2", "A")][0] == Decimal("100")


def test_entity_mode_climbs_through_parents_without_activity(spark):
    v = view(spark, [("t", "c", "m", 8, None, None, 0.5)])
    ents = spark.createDataFrame(
        [("t", "c", "m", Decimal("0.5")), ("t", "m", "top", Decimal("0.25")), ("t", "top", None, Decimal("1"))],
        "tenantid string, entityid string, parententityid string, percentage decimal(10,2)")
    got = entity_totals_of(entity_rollup_totals(v, ents))
    assert got[("t", "m")][0] == Decimal("4") and got[("t", "top")][0] == Decimal("1")


@pytest.mark.parametrize("seed", [5, 6])
def test_entity_mode_equals_reference_when_quirks_absent(spark, seed):
    """One tenant, one row per entity, depth-1 tree: both modes agree."""
    rnd = random.Random(seed)
    rows = [("t", "root", None, 5, None, None, 0.5)]
    rows += [("t", f"c{i}", "root", round(rnd.uniform(0, 9), 2), None, None, rnd.choice([0.25, 0.33, 1.0]))
             for i in range(8)]
    # ids that reach the report (the NULL parent group is dropped by the join)
    ent = {k[1]: v for k, v in entity_totals_of(entity_rollup_totals(view(spark, rows))).items()
           if k[1] is not None}
    ref = totals_of(rollup_totals(view(spark, rows)))
    assert ent == {k: v for k, v in ref.items() if k is not None}


def test_entity_report_attaches_on_tenant_and_entity(spark):
    rep = entity_rollup_report(view(spark, WORKED)).collect()
    a_rows = {r["tenantid"]: r["total_emissions_locationbased"] for r in rep if r["entityid"] == "A"}
    assert a_rows == {"t1": Decimal("16.5"), "t2": Decimal("100")}


def test_hot_entity_third_of_rows(spark):
    """One leaf entity holds a third of all activity rows: results stay exact
    and Spark broadcasts the small totals (no shuffle of the hot key)."""
    rows = [("t", "root", None, 1, None, None, 0.5)]
    rows += [("t", f"m{i}", "root", 2, None, None, 0.5) for i in range(6)]
    rows += [("t", f"l{i}", f"m{i % 6}", 1, None, None, 0.25) for i in range(400)]
    rows += [("t", "hot", "m0", round(0.01 * i, 2), None, None, 0.5) for i in range(210)]
    got = totals_of(rollup_totals(view(spark, rows)))
    ref = duck_recursive_totals(rows)
    assert {k: (v[0], v[1]) for k, v in ref.items()} == got
    report = rollup_report(view(spark, rows), sort=False)
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert report.count() == len(rows)


def test_rows_only_reach_their_own_levels(spark):
    """A 12-deep chain beside many depth-1 leaves: leaves only emit their own
    levels, totals still equal the literal recursion."""
    rows = [("t", "c0", None, 1, None, None, 0.5)]
    rows += [("t", f"c{i}", f"c{i - 1}", 1, None, None, 0.5) for i in range(1, 13)]
    rows += [("t", f"leaf{i}", "c0", 2, None, None, 0.25) for i in range(30)]
    v = view(spark, rows)
    per_entity = {}
    for r in level_amounts(v, hierarchy(edge_table(v))).collect():
        per_entity[r["entityid"]] = max(per_entity.get(r["entityid"], 0), r["level"])
    assert per_entity["leaf0"] == 2 and per_entity["c12"] == 13
    got = totals_of(rollup_totals(v))
    ref = duck_recursive_totals(rows)
    assert {k: (x[0], x[1]) for k, x in ref.items()} == got


def test_no_usable_edges(spark):
    """Rows without tenant or entity only contribute to themselves (level 0)."""
    rows = [(None, "A", "B", 1, None, None, 0.5), ("t", None, "B", 2, None, None, 0.5)]
    got = totals_of(rollup_totals(view(spark, rows)))
    ref = duck_recursive_totals(rows)
    assert {k: (x[0], x[1]) for k, x in ref.items()} == got
    assert len(rollup_report(view(spark, rows)).collect()) == 1  # entity A only


def test_shuffle_paths_when_nothing_may_be_broadcast(spark):
    """Without broadcasts totals reach V through a sort-merge join; results are unchanged."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        rows = list(WORKED) + [("t1", f"x{i}", "C", 1, None, None, 0.5) for i in range(5)]
        got = totals_of(rollup_totals(view(spark, rows)))
        ref = duck_recursive_totals(rows)
        assert {k: (x[0], x[1]) for k, x in ref.items()} == got
        report = rollup_report(view(spark, rows), sort=False)
        plan = report._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert report.count() == len(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")

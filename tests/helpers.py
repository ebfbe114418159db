"""Small builders shared by the tests."""
from decimal import Decimal

import duckdb

V_SCHEMA = (
    "tenantid string, entityid string, parententityid string, activityid string, "
    "emissioninkgco2 decimal(20,10), emissioninkgco2_forlocationbased decimal(20,10), "
    "emissioninkgco2_formarketbased decimal(20,10), parentcontributionpercentage decimal(10,2)"
)


def d(x):
    return None if x is None else Decimal(str(x))


def view(spark, rows):
    """rows: (tenant, entity, parent, total, loc, mkt, p) -> V DataFrame."""
    data = [
        (t, e, par, f"a{i}", d(tot), d(loc), d(mkt), d(p))
        for i, (t, e, par, tot, loc, mkt, p) in enumerate(rows)
    ]
    return spark.createDataFrame(data, V_SCHEMA)


def duck_recursive_totals(rows):
    """The roll-up walked by DuckDB's recursive SQL on the same rows."""
    con = duckdb.connect()
    con.execute(
        "CREATE TABLE v (tenantid VARCHAR, entityid VARCHAR, parententityid VARCHAR, "
        "activityid VARCHAR, emissioninkgco2 DECIMAL(20,10), "
        "emissioninkgco2_forlocationbased DECIMAL(20,10), "
        "emissioninkgco2_formarketbased DECIMAL(20,10), parentcontributionpercentage DECIMAL(10,2))"
    )
    for i, (t, e, par, tot, loc, mkt, p) in enumerate(rows):
        con.execute(
            "INSERT INTO v VALUES (?, ?, ?, ?, ?, ?, ?, ?)",
            [t, e, par, f"a{i}", d(tot), d(loc), d(mkt), d(p)],
        )
    from ecotally.plans.fixtures import ROLLUP_CTE_SQL

    sql = f"""WITH RECURSIVE {ROLLUP_CTE_SQL.strip()}
    SELECT place, SUM(by_location * weight), SUM(by_market * weight), SUM(weight) FROM walk GROUP BY place"""
    return {r[0]: (r[1], r[2], r[3]) for r in con.execute(sql).fetchall()}

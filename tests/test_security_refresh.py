"""Row-level security, rule maintenance, lookback and refreshes."""
import datetime

import pytest

from ecotally.functions.expressions import principal_name
from ecotally.operators.refresh import incremental_refresh, lookback
from ecotally.operators.security import apply_rls, create_secured_view, grant, upsert_rules

ADMINS = ["urn:u/admin", "urn:u/op", "urn:u/view"]
PREFIX = "urn:u/"


def data(spark):
    return spark.createDataFrame([(1, "t1"), (2, "t2"), (3, None)], "id int, tenantid string")


def rules(spark, rows):
    return spark.createDataFrame(rows, "UserArn string, tenantid string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_rls_tenant_admin_and_absent(spark):
    r = rules(spark, [("u1", "t1"), ("adm", ""), ("nul", None), ("u2", "t2")])
    assert ids(apply_rls(data(spark), r, "u1")) == [1]
    assert ids(apply_rls(data(spark), r, "adm")) == [1, 2, 3]
    # a rule that lost its tenant grants nothing, unless asked for
    assert ids(apply_rls(data(spark), r, "nul")) == []
    assert ids(apply_rls(data(spark), r, "nul", null_is_unrestricted=True)) == [1, 2, 3]
    assert ids(apply_rls(data(spark), r, "nobody")) == []


def test_one_view_serves_every_reader(spark, tmp_dir):
    """The same view read by two users, an unrestricted one and one without a rule; a
    grant made later is seen without making the view anew."""
    key = tmp_dir.rpartition("-")[2].replace("-", "_")
    path = f"{tmp_dir}/rules"
    rules(spark, [("u1", "t1"), ("u2", "t2"), ("adm", ""), ("nul", None)]).write.parquet(path)
    data(spark).createOrReplaceTempView(f"d_{key}")
    spark.sql(f"CREATE TEMPORARY VIEW r_{key} AS SELECT * FROM parquet.`{path}`")
    create_secured_view(spark, f"d_{key}", f"r_{key}", f"seen_{key}")
    reader = spark._jvm.org.apache.spark.sql.catalyst.CurrentUserContext.CURRENT_USER()

    def seen(user):
        reader.set(user)
        try:
            return ids(spark.table(f"seen_{key}"))
        finally:
            reader.remove()

    assert seen("u1") == [1] and seen("u2") == [2] and seen("adm") == [1, 2, 3]
    assert seen("nul") == [] and seen("nobody") == []
    rules(spark, [("nobody", "t2")]).write.mode("append").parquet(path)
    assert seen("nobody") == [2]
    assert "u1" not in spark.table(f"seen_{key}")._jdf.queryExecution().analyzed().toString()


def test_rls_union_of_tenants_equals_granted_rows(spark):
    r = rules(spark, [("u1", "t1"), ("u2", "t2")])
    u = apply_rls(data(spark), r, "u1").unionByName(apply_rls(data(spark), r, "u2"))
    assert ids(u) == [1, 2]


def test_upsert_last_write_wins(spark):
    old = rules(spark, [("a", "t0"), ("b", "t0")])
    g = spark.createDataFrame([("a", "t1", 1), ("a", "t2", 2), ("c", "t3", 1)], "UserArn string, tenantid string, seq long")
    got = sorted(tuple(r) for r in upsert_rules(old, g).collect())
    assert got == [("a", "t2"), ("b", "t0"), ("c", "t3")]


def test_bootstrap_writes_admins_and_skips_tenant(spark):
    ev = spark.createDataFrame([("testTenant", "12345", 1)], "tenant string, tenantid string, seq long")
    out = sorted(tuple(r) for r in grant(rules(spark, []), ev, ADMINS, PREFIX).collect())
    assert out == sorted((a, "") for a in ADMINS)


def test_bootstrap_loses_the_first_event_only(spark):
    ev = spark.createDataFrame([("a", "1", 5), ("b", "2", 3), ("c", "3", 9), ("b", "4", 7)],
                               "tenant string, tenantid string, seq long")
    out = {tuple(r) for r in grant(rules(spark, []), ev, ADMINS, PREFIX).collect()}
    arn = "urn:u/{0}/{0}TenantRole/{0}".format
    assert out == {(a, "") for a in ADMINS} | {(arn("a"), "1"), (arn("b"), "4"), (arn("c"), "3")}
    # a repeated first event is stored by its repeat
    twice = spark.createDataFrame([("b", "2", 3), ("b", "2", 3)], "tenant string, tenantid string, seq long")
    assert (arn("b"), "2") in {tuple(r) for r in grant(rules(spark, []), twice, ADMINS, PREFIX).collect()}
    # no event: nothing is written
    assert grant(rules(spark, []), ev.limit(0), ADMINS, PREFIX).count() == 0


def test_upsert_needs_an_order(spark):
    with pytest.raises(ValueError):
        upsert_rules(rules(spark, []), rules(spark, [("a", "1")]))


def test_rls_reads_rules_when_the_result_is_read(spark, tmp_dir):
    path = f"{tmp_dir}/rules"
    rules(spark, [("u1", "t1")]).write.parquet(path)
    seen = apply_rls(data(spark), spark.read.parquet(path), "u1")
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistenceJoin" in plan or "LeftSemi" in plan
    assert ids(seen) == [1]


def test_grant_with_admin_present_writes_tenant_row(spark):
    ev = spark.createDataFrame([("testTenant", "12345", 1)], "tenant string, tenantid string, seq long")
    base = rules(spark, [(a, "") for a in ADMINS])
    out = sorted(tuple(r) for r in grant(base, ev, ADMINS, PREFIX).collect())
    assert ("urn:u/testTenant/testTenantTenantRole/testTenant", "12345") in out and len(out) == 4


def test_grant_not_faithful_writes_both(spark):
    ev = spark.createDataFrame([("x", "9", 1)], "tenant string, tenantid string, seq long")
    out = grant(rules(spark, []), ev, ADMINS, PREFIX, faithful=False).collect()
    assert len(out) == 4


def test_principal_name(spark):
    df = spark.createDataFrame([("acme",)], "t string")
    assert df.select(principal_name("t", PREFIX)).first()[0] == "urn:u/acme/acmeTenantRole/acme"


def events(spark, shift=0.0):
    base = datetime.datetime(2024, 1, 10)
    rows = [(i, base - datetime.timedelta(hours=12 * i), float(i) + shift) for i in range(6)]
    rows.append((99, None, 1.0 + shift))
    return spark.createDataFrame(rows, "id int, ts timestamp_ntz, value double")


def test_lookback_inclusive_boundary(spark):
    got = ids(lookback(events(spark), "ts", datetime.datetime(2024, 1, 10), days=1))
    assert got == [0, 1, 2]  # 0h, 12h and exactly 24h back


def test_incremental_refresh_idempotent(spark):
    as_of = datetime.datetime(2024, 1, 10)
    target, source = events(spark, shift=100.0), events(spark)
    once = incremental_refresh(target, source, "ts", as_of)
    twice = incremental_refresh(once, source, "ts", as_of)
    a = sorted(tuple(r) for r in once.collect())
    assert a == sorted(tuple(r) for r in twice.collect())
    vals = {r["id"]: r["value"] for r in once.collect()}
    assert vals[0] == 0.0 and vals[5] == 105.0 and vals[99] == 101.0

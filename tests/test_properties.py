"""Property tests against plain-Python models (Hypothesis, few examples:
each one is a Spark job)."""
import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ecotally.operators.refresh import incremental_refresh
from ecotally.operators.security import apply_rls, upsert_rules

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

users = st.sampled_from(["u1", "u2", "u3", "u4"])
tenants = st.sampled_from(["", "t1", "t2", "t3"])


@SETTINGS
@given(rules=st.dictionaries(users, tenants, max_size=4),
       grants=st.lists(st.tuples(users, tenants), max_size=8))
def test_upsert_is_last_write_wins(spark, rules, grants):
    r = spark.createDataFrame(list(rules.items()), "UserArn string, tenantid string")
    g = spark.createDataFrame([(u, t, i) for i, (u, t) in enumerate(grants)],
                              "UserArn string, tenantid string, seq long")
    model = dict(rules)
    for u, t in grants:  # in seq order
        model[u] = t
    got = {row["UserArn"]: row["tenantid"] for row in upsert_rules(r, g).collect()}
    assert got == model


@SETTINGS
@given(rules=st.lists(st.tuples(users, st.sampled_from(["", "t1", "t2", None])), max_size=6),
       principal=users)
def test_rls_matches_model(spark, rules, principal):
    data = spark.createDataFrame([(i, t) for i, t in enumerate(["t1", "t2", "t3", None])],
                                 "id int, tenantid string")
    r = spark.createDataFrame(rules, "UserArn string, tenantid string")
    mine = [t for u, t in rules if u == principal]
    if "" in mine:
        expect = [0, 1, 2, 3]
    else:
        expect = [i for i, t in enumerate(["t1", "t2", "t3", None]) if t and t in mine]
    got = sorted(row["id"] for row in apply_rls(data, r, principal).collect())
    assert got == expect


hours = st.integers(min_value=0, max_value=96)


@SETTINGS
@given(old=st.lists(st.one_of(st.none(), hours), max_size=6),
       new=st.lists(st.one_of(st.none(), hours), max_size=6))
def test_incremental_refresh_matches_model(spark, old, new):
    base = datetime.datetime(2024, 1, 1)
    as_of = base + datetime.timedelta(hours=72)
    cut = as_of - datetime.timedelta(days=1)
    ts = lambda h: None if h is None else base + datetime.timedelta(hours=h)
    target = spark.createDataFrame([("old", ts(h)) for h in old], "src string, ts timestamp_ntz")
    source = spark.createDataFrame([("new", ts(h)) for h in new], "src string, ts timestamp_ntz")
    model = [("old", ts(h)) for h in old if h is None or ts(h) < cut]
    model += [("new", ts(h)) for h in new if h is not None and ts(h) >= cut]
    got = [tuple(r) for r in incremental_refresh(target, source, "ts", as_of).collect()]
    key = lambda x: (x[0], x[1] or datetime.datetime.min)
    assert sorted(got, key=key) == sorted(model, key=key)

"""Committed datasets: a writer lost at any step, competing writers, vacuum."""
import datetime
import os

import pytest
from pyspark.sql import functions as F

from ecotally.operators import refresh
from ecotally.operators.refresh import full_refresh, publish_by_day, read_published, refresh_published
from ecotally.plans import batch
from ecotally.plans.batch import read_rules_dataset, refresh_rules
from ecotally.sources import committed
from ecotally.sources.committed import CommitConflict, newest_commit, read_committed, replace_all, vacuum

DAYS = [datetime.datetime(2024, 1, d) for d in (7, 9, 10)]


class Lost(BaseException):
    """The writer dies here; nothing handles it."""


def report(spark, v, extra=False):
    df = spark.createDataFrame([(i, t, v) for i, t in enumerate(DAYS)] + [(9, None, v)], "k int, date timestamp_ntz, v int")
    return df.withColumn("more", F.lit("x")) if extra else df


def rows(spark, target):
    return sorted((r["k"], r["v"]) for r in read_published(spark, target).collect())


OLD = [(0, 1), (1, 1), (2, 1), (9, 1)]
NEW = [(0, 1), (1, 2), (2, 2), (9, 1)]


def lose(monkeypatch, name, before):
    real = getattr(committed, name)

    def dying(*args, **kwargs):
        if not before:
            real(*args, **kwargs)
        raise Lost

    monkeypatch.setattr(committed, name, dying)
    if hasattr(refresh, name):
        monkeypatch.setattr(refresh, name, dying)


@pytest.mark.parametrize("name", ["write_version", "_put", "_publish"])
@pytest.mark.parametrize("before", [True, False])
def test_a_lost_refresh_leaves_old_or_new_rows(spark, tmp_dir, monkeypatch, name, before):
    target = os.path.join(tmp_dir, "pub")
    publish_by_day(report(spark, 1), target)
    with monkeypatch.context() as m:
        lose(m, name, before)
        with pytest.raises(Lost):
            refresh_published(report(spark, 2), target, as_of=DAYS[-1], days=1)
    assert rows(spark, target) == (NEW if name == "_publish" and not before else OLD)
    # what it left behind does not matter, and goes
    refresh_published(report(spark, 2), target, as_of=DAYS[-1], days=1)
    assert rows(spark, target) == NEW
    vacuum(spark, target, keep=1)
    assert rows(spark, target) == NEW
    listed = set(newest_commit(spark, target).folders)
    found = {f"{v}/{d}" for v in os.listdir(f"{target}/_versions") for d in os.listdir(f"{target}/_versions/{v}") if "=" in d}
    assert found == listed and len(os.listdir(f"{target}/_committed")) - len([n for n in os.listdir(f"{target}/_committed") if n[0] == "."]) == 1


def test_a_rename_that_is_reported_lost_but_was_made(spark, tmp_dir, monkeypatch):
    target, real = os.path.join(tmp_dir, "pub"), committed._publish

    def unsure(*args):
        real(*args)
        raise OSError("no answer")

    monkeypatch.setattr(committed, "_publish", unsure)
    publish_by_day(report(spark, 1), target)
    assert rows(spark, target) == OLD


def test_half_written_version_is_not_read(spark, tmp_dir):
    target = os.path.join(tmp_dir, "rules")
    full_refresh(spark.createDataFrame([("a", "1")], "UserArn string, tenantid string"), target)
    os.makedirs(f"{target}/_versions/version=000001-abc/_temporary/0")
    open(f"{target}/_committed/.staged", "w").close()
    assert [tuple(r) for r in read_rules_dataset(spark, target).collect()] == [("a", "1")]


def test_first_import_lost_leaves_no_dataset(spark, tmp_dir, monkeypatch):
    target = os.path.join(tmp_dir, "pub")
    with monkeypatch.context() as m:
        lose(m, "_publish", True)
        with pytest.raises(Lost):
            publish_by_day(report(spark, 1), target)
    assert newest_commit(spark, target) is None
    with pytest.raises(FileNotFoundError):
        read_committed(spark, target)
    assert refresh.publish_or_refresh(report(spark, 1), target) is True
    assert rows(spark, target) == OLD


def test_competing_writers_do_not_undo_each_other(spark, tmp_dir):
    target = os.path.join(tmp_dir, "set")
    one = spark.createDataFrame([(1,)], "x int")
    first = replace_all(one, target)
    replace_all(one.withColumn("x", F.lit(2)), target, base=first)
    with pytest.raises(CommitConflict):
        replace_all(one.withColumn("x", F.lit(3)), target, base=first)
    with pytest.raises(CommitConflict):
        replace_all(one, target, base=None)
    assert [r["x"] for r in read_committed(spark, target).collect()] == [2]


def test_no_grant_is_lost_to_another_writer_or_pruning(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "rules")

    def event(tenant, seq):
        return spark.createDataFrame([(tenant, tenant + "1", seq)], "tenant string, tenantid string, seq long")

    def tenants():
        return {r["tenantid"] for r in read_rules_dataset(spark, path).collect()}

    refresh_rules(spark, path, event("z", 0), ["adm"], "u/")  # writes the admin row only
    for k, t in enumerate("abc"):
        refresh_rules(spark, path, event(t, k), ["adm"], "u/")
        vacuum(spark, path, keep=1)
    assert tenants() == {"", "a1", "b1", "c1"}
    # another writer commits between reading and committing
    real, done = batch.grant, []

    def slow(rules, *args):
        out = real(rules, *args)
        if not done:
            done.append(1)
            refresh_rules(spark, path, event("other", 8), ["adm"], "u/")
        return out

    monkeypatch.setattr(batch, "grant", slow)
    refresh_rules(spark, path, event("mine", 9), ["adm"], "u/")
    assert tenants() == {"", "a1", "b1", "c1", "other1", "mine1"}


def test_columns_may_come_but_not_change(spark, tmp_dir):
    target = os.path.join(tmp_dir, "pub")
    publish_by_day(report(spark, 1), target)
    refresh_published(report(spark, 2, extra=True), target, as_of=DAYS[-1], days=0)
    got = {r["k"]: r["more"] for r in read_published(spark, target).collect()}
    assert got == {0: None, 1: None, 2: "x", 9: None}
    with pytest.raises(ValueError):
        refresh_published(report(spark, 2).withColumn("v", F.lit("text")), target, as_of=DAYS[-1])


def test_empty_datasets(spark, tmp_dir):
    target = os.path.join(tmp_dir, "pub")
    publish_by_day(report(spark, 1).limit(0), target)
    assert read_published(spark, target).columns == ["k", "date", "v"] and rows(spark, target) == []
    refresh_published(report(spark, 2), target, as_of=DAYS[-1], days=30)
    assert rows(spark, target) == [(0, 2), (1, 2), (2, 2)]  # rows without a date are outside every window

"""Live queries: every view equals the query run anew, after every change (LIVE_STEPS of them)."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark.database import Database
from tidemark.errors import NotIncremental
from tidemark.plans.expr import col
from tidemark.streaming import changelog, zset
from .fixtures import harbour, ids, table


def multiset(rows):
    return sorted(repr(sorted(r.items(), key=str)) for r in rows)


PLANS = {
    "filter": lambda d: d.select("*").from_("l").where(~col("v").gt(2)),
    "project": lambda d: d.select("k", (col("v") + 1, "w")).from_("l"),
    "inner": lambda d: d.select("l.id", "r.id").from_("l").inner_join("r", col("l.k").eq(col("r.k"))),
    "left": lambda d: d.select("l.id", "r.id").from_("l").left_join("r", col("l.k").eq(col("r.k"))),
    "right": lambda d: d.select("l.id", "r.id").from_("l").right_join("r", col("l.k").eq(col("r.k"))),
    "full": lambda d: d.select("l.id", "r.id").from_("l").full_join("r", col("l.k").eq(col("r.k"))),
    "conditions": lambda d: d.select("l.id", "r.id").from_("l").left_join("r", col("l.k").eq(col("r.k")) & col("l.v").lt(col("r.v"))),
    "theta_right": lambda d: d.select("l.id", "r.id").from_("l").right_join("r", col("l.v").lt(col("r.v"))),
    "theta_full": lambda d: d.select("l.id", "r.id").from_("l").full_join("r", col("l.v").lt(col("r.v")) & col("l.k").ne(col("r.k"))),
    "theta_left": lambda d: d.select("l.id", "r.id").from_("l").left_join("r", col("l.v").lt(col("r.v"))),
    "cross": lambda d: d.select("l.id", "r.id").from_("l").cross_join("r"),
    "aggregate": lambda d: d.select("*").from_("l").group_by("k").count().count_col("v").sum("v").min("v").max("v").distinct("v"),
    "linear": lambda d: d.select("*").from_("l").group_by("k").count().count_col("v").sum("v").avg("v"),
    "global_linear": lambda d: d.select("*").from_("l").count().count_col("v").sum("v").avg("v"),
    "global": lambda d: d.select("*").from_("l").count().sum("v").max("v"),
    "join_aggregate": lambda d: d.select("*").from_("l").left_join("r", col("l.k").eq(col("r.k"))).group_by("l.k").count_col("r.v").sum("r.v"),
    "union": lambda d: d.select("k").from_("l").union(d.select("k").from_("r")),
    "union_all": lambda d: d.select("k").from_("l").union_all(d.select("k").from_("r")),
}


def test_views_follow_random_changes(spark):
    db = Database(spark)
    columns = [("id", "Int64"), ("k", "Int32", None), ("v", "Int32", None)]
    table(db, "l", columns, [(1, 1, 1), (2, None, 2), (3, 2, None)])
    table(db, "r", columns, [(1, 1, 5), (2, None, 1)])
    views = {n: make(db).trace() for n, make in PLANS.items()}
    told = {n: [] for n in PLANS}
    for n, v in views.items():
        v.subscribe(told[n].append)
    start = {n: multiset(v.get_result()) for n, v in views.items()}
    rng = random.Random(4)
    value = lambda top: rng.choice([None, *range(top)])
    changes = [("l", "update"), ("r", "insert"), ("l", "delete"), ("r", "update"), ("l", "insert"), ("r", "delete")]
    for step, (name, act) in enumerate(changes[: int(os.environ.get("LIVE_STEPS", 2))]):
        if act == "insert":
            db.insert(name).values([{"id": 10 + step + 100 * i, "k": value(3), "v": value(4)} for i in range(2)]).exec()
        elif act == "update":
            db.update(name).set({"k": value(3), "v": value(4)}).where(col("id").lte(2)).exec()
        else:
            db.delete(name).where(col("id").eq(3) | col("k").eq(0)).exec()
        for n, make in PLANS.items():
            assert multiset(views[n].get_result()) == multiset(make(db).exec()), (step, n)
    for n in PLANS:  # what was told adds up to the difference
        now = start[n]
        for change in told[n]:
            now = now + multiset(change["added"])
            for gone in multiset(change["removed"]):
                now.remove(gone)
        assert sorted(now) == multiset(views[n].get_result()), n


def test_sorted_queries_have_no_deltas(spark):
    with pytest.raises(NotIncremental):
        harbour(spark).select("*").from_("trips").order_by("id").trace()


def test_observe_and_changes(spark):
    db = harbour(spark)
    query = lambda: db.select("id").from_("trips").where(col("tons").gt(50)).order_by("id")
    quiet, eager, seen, all_seen = query().observe(), query().changes(), [], []
    end = quiet.subscribe(seen.append)
    eager.subscribe(all_seen.append)
    assert (seen, [ids(r) for r in all_seen]) == ([], [[22, 23, 24]])
    db.update("trips").set({"tons": 45}).where(col("id").eq(21)).exec()  # not visible
    assert seen == []
    db.insert("trips").values([{"id": 26, "ship_id": 3, "tons": 70}]).exec()
    assert [ids(r) for r in seen] == [[22, 23, 24, 26]] and len(all_seen) == 2 and len(quiet) == 4
    end()
    db.delete("trips").exec()
    assert len(seen) == 1 and len(all_seen) == 3 and quiet.subscription_count() == 0
    assert quiet.get_result() == []  # it catches up when it is read
    quiet.close()
    assert db.live.query_count() == 1


def test_filters_are_patched(spark, monkeypatch):
    """A filter and projection follows changes without running again."""
    db = harbour(spark)
    live, seen = db.select("ship_id").from_("trips").where(col("tons").gte(60)).observe(), []
    live.subscribe(seen.append)
    monkeypatch.setattr(live, "_start", None)
    db.insert("trips").values([{"id": 30, "ship_id": 1, "tons": 99}, {"id": 31, "ship_id": 9, "tons": 1}]).exec()
    db.delete("trips").where(col("id").eq(22)).exec()
    db.update("trips").set({"tons": 77}).where(col("id").eq(23)).exec()  # the row stays the same
    assert [sorted(r["ship_id"] for r in x) for x in seen] == [[1, 1, 2, 4], [1, 2, 4]]


def test_queries_nobody_hears_are_not_maintained(spark, monkeypatch):
    db = harbour(spark)
    view = db.select("*").from_("trips").where(col("tons").gt(50)).trace()
    monkeypatch.setattr(zset, "delta", None)
    db.delete("trips").where(col("id").eq(22)).exec()
    assert ids(view.get_result()) == [23, 24]
    monkeypatch.undo()
    told = []
    db.delete("trips").where(col("id").eq(23)).exec()
    view.subscribe(told.append)
    db.delete("trips").where(col("id").eq(24)).exec()
    assert [ids(t["removed"]) for t in told] == [[24]] and len(view) == 0


def test_a_change_does_not_rewrite_the_view(spark, monkeypatch):
    from tidemark.streaming import live

    monkeypatch.setattr(live, "MERGE_EVERY", 3)
    db = harbour(spark)
    view = db.select("*").from_("trips").where(col("tons").gt(1)).trace().keep_current()
    base = view.view
    for i in range(2):
        db.insert("trips").values([{"id": 40 + i, "ship_id": 1, "tons": 9}]).exec()
        assert view.view is base and len(view.log) == i + 1
    db.delete("trips").where(col("id").eq(40)).exec()
    assert view.view is not base and not view.log and ids(view.get_result()) == [21, 22, 23, 24, 25, 41]


def test_changes_that_do_not_show_are_not_told(spark):
    """An update of a column that is projected away moves nothing, below a filter too."""
    db = harbour(spark)
    both = db.select("ship_id").from_("trips").union_all(db.select("ship_id").from_("trips")).where(col("ship_id").lt(3)).trace()
    told = []
    both.subscribe(told.append)
    db.update("trips").set({"tons": 1}).where(col("id").eq(21)).exec()
    assert told == []
    db.delete("trips").where(col("id").eq(21)).exec()
    assert [len(t["removed"]) for t in told] == [2] and len(both) == 6


def test_transactions_tell_once(spark):
    db = harbour(spark)
    view, told = db.select("*").from_("trips").trace(), []
    view.subscribe(told.append)
    tx = db.transaction()
    tx.insert("trips", [{"id": 40, "ship_id": 1, "tons": 1}])
    tx.delete("trips", col("id").eq(40))
    tx.delete("trips", col("id").eq(21))
    assert told == []
    tx.commit()
    assert [(ids(t["added"]), ids(t["removed"])) for t in told] == [([], [21])]
    tx = db.transaction()
    tx.delete("trips")
    tx.rollback()
    assert len(told) == 1 and len(view) == 4


def test_batches_tell_once(spark):
    db = harbour(spark)
    view, told = db.select("*").from_("trips").group_by("ship_id").sum("tons").trace(), []
    view.subscribe(told.append)
    with db.batched():
        db.insert("trips").values([{"id": 60, "ship_id": 2, "tons": 5}]).exec()
        db.delete("trips").where(col("ship_id").eq(1)).exec()
        assert told == []
    (change,) = told
    assert sorted(r["sum_tons"] for r in change["added"]) == [65] and sorted(r["sum_tons"] for r in change["removed"]) == [60, 120]


def test_linear_aggregate(spark):
    db = harbour(spark)
    plan = db.select("*").from_("trips").group_by("ship_id").count().sum("tons").avg("tons").plan()
    kept = zset.LinearAggregate(plan, db.snapshot())
    before = db.snapshot()
    change = zset.weighted(spark.createDataFrame([(30, 2, 20)], "id long, ship_id long, tons long")).union(zset.weighted(db.table("trips").where("ship_id = 1"), -1))
    moved = kept.apply(zset.delta(plan.input, before, before, {"trips": change}))
    assert sorted(map(tuple, moved.collect())) == [(1, 3, 120, 40.0, -1), (2, 1, 60, 60.0, -1), (2, 2, 80, 40.0, 1)]
    assert sorted(map(tuple, kept.frame().collect())) == [(2, 2, 80, 40.0), (4, 1, 60, 60.0)]


def test_change_log(spark, tmp_path):
    db = harbour(spark)
    view = db.select("*").from_("trips").group_by("ship_id").sum("tons").trace()
    log = str(tmp_path / "log")
    changelog.append(spark.createDataFrame([(40, 3, 7)], "id long, ship_id long, tons long"), log)
    changelog.append(db.table("trips").where("id = 23"), log, -1)
    changes = changelog.ChangeLog(db, "trips", log)
    query = changes.start(str(tmp_path / "checkpoint"))
    query.awaitTermination()
    expected = {1: 120, 3: 7, 4: 60}
    assert {r["ship_id"]: r["sum_tons"] for r in view.get_result()} == expected
    changes.apply(zset.weighted(db.table("trips").limit(1)), 0)  # delivered again: nothing happens
    assert db.table("trips").count() == 5
    # A new process has the table as it was at first; the log brings it to where the stream is.
    later = harbour(spark)
    again = changelog.ChangeLog(later, "trips", log)
    assert again.applied == changes.applied and sorted(map(tuple, later.table("trips").collect())) == sorted(map(tuple, db.table("trips").collect()))
    changelog.append(spark.createDataFrame([(41, 4, 1)], "id long, ship_id long, tons long"), log)
    query = again.start(str(tmp_path / "checkpoint"))
    query.awaitTermination()
    assert later.table("trips").count() == 6


def test_consolidate(spark):
    z = spark.createDataFrame([(None, 1), (None, -1), ("a", 2), ("b", -1)], "x string, _d long")
    assert sorted(map(tuple, zset.consolidate(z).collect())) == [("a", 2), ("b", -1)]
    assert zset.rows(z.where("x = 'a'")).count() == 2
    assert zset.difference(spark.range(3), spark.range(1, 4)).where(F.col("_d") < 0).first()["id"] == 3

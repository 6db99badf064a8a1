"""Queries on the fixture tables, with the rows worked out by hand."""

import math

import pytest

from tidemark.database import Database
from tidemark.errors import ColumnNotFound, EngineError, TableNotFound, TypeMismatch
from tidemark.plans.expr import col
from .fixtures import DEPTHS, SAILORS, crew, gauges, harbour, ids, ranks, table


@pytest.fixture(scope="module")
def store(spark):
    return harbour(spark)


MADE = col("ships.id").eq(col("trips.ship_id"))


def test_names_of_a_join(store):
    rows = store.select("*").from_("ships").inner_join("trips", MADE).exec()
    assert sorted(rows[0]) == ["name", "ship_id", "ships.id", "tons", "trips.id"]
    rows = store.select("ships.name", "trips.id").from_("ships").inner_join("trips", MADE).exec()
    assert sorted(rows[0]) == ["id", "name"]
    rows = store.select("ships.id", "trips.id").from_("ships").inner_join("trips", MADE).exec()
    assert sorted(rows[0]) == ["ships.id", "trips.id"]


def test_bare_name_in_on_means_the_joined_table_first(store):
    assert len(store.select("*").from_("ships").inner_join("trips", col("ship_id").eq(col("ships.id"))).exec()) == 5


def test_left_join_keeps_rows(store):
    rows = store.select("name", "tons").from_("ships").left_join("trips", MADE).exec()
    assert sorted((r["name"], r["tons"] or 0) for r in rows) == [("Alba", 5), ("Alba", 40), ("Alba", 75), ("Brisa", 60), ("Corvo", 0), ("Dorsal", 60)]


def test_three_way_left_join(store):
    q = store.select("name", "kind").from_("ships").left_join("trips", MADE).left_join("dues", col("trips.id").eq(col("dues.trip_id")))
    assert sorted((r["name"], r["kind"] or "-") for r in q.exec()) == [("Alba", "-"), ("Alba", "-"), ("Alba", "berth"), ("Alba", "pilot"), ("Brisa", "berth"), ("Corvo", "-"), ("Dorsal", "-")]


def test_right_full_cross(store):
    assert len(store.select("*").from_("trips").right_join("ships", MADE).exec()) == 6
    assert len(store.select("*").from_("trips").full_join("dues", col("trips.id").eq(col("dues.trip_id"))).exec()) == 6
    assert len(store.select("*").from_("trips").cross_join("ships").exec()) == 20


def test_null_keys_do_not_join(spark):
    db = ranks(spark)
    q = db.select("ranks.name", "b.name").from_("ranks").inner_join("ranks as b", col("ranks.above").eq(col("b.id")))
    assert sorted((r["ranks.name"], r["b.name"]) for r in q.exec()) == [("boy", "mate"), ("cook", "captain"), ("mate", "captain")]
    q = db.select("ranks.name", "b.name").from_("ranks").left_join("ranks AS b", col("ranks.above").eq(col("b.id")))
    assert ("captain", None) in [(r["ranks.name"], r["b.name"]) for r in q.exec()]


def test_theta_joins(spark):
    db = Database(spark)
    table(db, "berths", [("id", "Int64"), ("depth", "Int32", None)], [(1, 4), (2, 7), (3, None), (4, 2)])
    table(db, "hulls", [("id", "Int64"), ("draught", "Int32")], [(10, 3), (11, 6), (12, 9)])
    fits = col("berths.depth").gt(col("hulls.draught"))
    pairs = lambda q: sorted(((r["berths.id"], r["hulls.id"]) for r in q.exec()), key=str)
    chosen = lambda: db.select("berths.id", "hulls.id").from_("berths")
    assert pairs(chosen().inner_join("hulls", fits)) == [(1, 10), (2, 10), (2, 11)]
    assert pairs(chosen().left_join("hulls", fits)) == [(1, 10), (2, 10), (2, 11), (3, None), (4, None)]
    assert pairs(chosen().full_join("hulls", fits)) == [(1, 10), (2, 10), (2, 11), (3, None), (4, None), (None, 12)]
    assert pairs(chosen().inner_join("hulls", ~col("berths.depth").eq(col("hulls.draught")) & fits)) == [(1, 10), (2, 10), (2, 11)]


def test_aggregates(spark):
    db = gauges(spark)
    row = db.select("*").from_("gauges").count().sum("depth").avg("depth").min("depth").max("depth").distinct("depth").stddev("depth").geomean("depth").exec()[0]
    depths = [d for _, _, d in DEPTHS]
    assert (row["count"], row["sum_depth"], row["avg_depth"], row["min_depth"], row["max_depth"], row["distinct_depth"]) == (5, 30, 6.0, 3, 12, 3)
    assert row["stddev_depth"] == pytest.approx(math.sqrt(sum((d - 6) ** 2 for d in depths) / 5))
    assert row["geomean_depth"] == pytest.approx(math.prod(depths) ** 0.2)
    assert list(row) == ["count", "sum_depth", "avg_depth", "min_depth", "max_depth", "distinct_depth", "stddev_depth", "geomean_depth"]


def test_aggregates_of_what_is_no_number(spark):
    row = gauges(spark).select("*").from_("gauges").sum("place").avg("place").stddev("place").geomean("place").max("place").exec()[0]
    assert tuple(row.values()) == (0, None, None, None, "south")


def test_sums_go_to_the_bound(spark):
    db = Database(spark)
    table(db, "t", [("id", "Int64"), ("g", "Int32"), ("v", "Int64", None)], [(1, 1, 2**63 - 1), (2, 1, 5), (3, 2, -(2**63)), (4, 2, -1), (5, 3, 7), (6, 3, None)])
    found = {r["g"]: r["sum_v"] for r in db.select("*").from_("t").group_by("g").sum("v").exec()}
    assert found == {1: 2**63 - 1, 2: -(2**63), 3: 7}


def test_aggregates_of_nothing(spark):
    db = gauges(spark)
    none = lambda: db.select("*").from_("gauges").where(col("depth").gt(100))
    row = none().count().count_col("depth").sum("depth").avg("depth").min("depth").distinct("depth").stddev("depth").geomean("depth").exec()[0]
    assert tuple(row.values()) == (0, 0, 0, None, None, 0, None, None)
    assert none().group_by("place").count().exec() == []


def test_aggregates_see_nulls(spark):
    db = Database(spark)
    table(db, "hauls", [("id", "Int64"), ("net", "String", None), ("kilos", "Int32", None)], [(1, "x", 5), (2, "x", None), (3, None, 1), (4, None, None), (5, "x", -3), (6, "x", 5), (7, "x", 20)])
    rows = db.select("*").from_("hauls").group_by("net").count().count_col("kilos").sum("kilos").distinct("kilos").geomean("kilos").exec()
    found = {r["net"]: (r["count"], r["count_kilos"], r["sum_kilos"], r["distinct_kilos"]) for r in rows}
    assert found == {"x": (5, 4, 27, 4), None: (2, 1, 1, 2)}
    assert {r["net"]: round(r["geomean_kilos"], 6) for r in rows} == {"x": round(500 ** (1 / 3), 6), None: 1.0}


def test_order_by_an_aggregate(store):
    q = store.select("*").from_("ships").left_join("trips", MADE).group_by("name").sum("tons").count_col("trips.id").order_by("sum_tons", "desc").order_by("name")
    assert [(r["name"], r["sum_tons"], r["count_id"]) for r in q.exec()] == [("Alba", 120, 3), ("Brisa", 60, 1), ("Dorsal", 60, 1), ("Corvo", 0, 0)]


def test_sort_limit_offset(spark):
    db = crew(spark)
    by_years = [name for _, name, *_ in sorted(SAILORS, key=lambda r: (r[2], -r[4], r[0]))]
    assert [r["name"] for r in db.select("name").from_("sailors").order_by("years").order_by("pay", "desc").order_by("id").limit(5).exec()] == by_years[:5]
    assert [r["id"] for r in db.select("id").from_("sailors").order_by("id").offset(6).exec()] == [7, 8]
    assert [r["id"] for r in db.select("id").from_("sailors").order_by("port").order_by("id").limit(3).exec()] == [6, 4, 8]
    assert [r["id"] for r in db.select("id").from_("sailors").order_by("port", "desc").order_by("id").exec()][-1] == 6


def test_unions(store):
    few = lambda: store.select("name").from_("ships").where(col("id").lte(2))
    every = store.select("name").from_("ships")
    assert sorted(r["name"] for r in few().union_all(every).exec()) == ["Alba", "Alba", "Brisa", "Brisa", "Corvo", "Dorsal"]
    assert [r["name"] for r in few().union(store.select("name").from_("ships")).where(col("name").ne("Brisa")).order_by("name", "desc").exec()] == ["Dorsal", "Corvo", "Alba"]
    with pytest.raises(TypeMismatch):
        store.select("name").from_("ships").union(store.select("id").from_("ships"))


def test_errors(store):
    with pytest.raises(TableNotFound):
        store.select("*").from_("nope")
    with pytest.raises(ColumnNotFound):
        store.select("nope").from_("ships").exec()
    with pytest.raises(EngineError):
        store.select("*").exec()


def test_prepare_explain_arrow(spark):
    db = crew(spark)
    prepared = db.select("id").from_("sailors").where(col("years").gt(15)).prepare()
    assert ids(prepared.exec()) == [4, 7]
    db.insert("sailors").values([{"id": 9, "name": "H", "years": 50, "ashore": True, "pay": 1.0}]).exec()
    assert ids(prepared.exec()) == [4, 7, 9]
    assert set(db.select("*").from_("sailors").explain()) == {"logical", "optimized", "physical"}
    assert prepared.arrow().num_rows == 3
    db.drop_table("sailors")
    with pytest.raises(TableNotFound):
        prepared.exec()


def test_tables_are_written_and_read(spark, tmp_path):
    from tidemark.sources.store import read_table, write_table

    rows = crew(spark).table("sailors")
    write_table(rows, f"{tmp_path}/sailors.parquet", partition_by=("ashore",))
    db = Database(spark)
    db.register_table(read_table(spark, str(tmp_path), "sailors"), "sailors")
    q = db.select("id").from_("sailors").where(col("ashore").eq(True) & col("years").gt(5))
    assert ids(q.exec()) == [4, 8]
    assert "PartitionFilters: [isnotnull(ashore" in q.explain()["physical"]

"""Schemas, mutations, transactions."""

import datetime as dt

import pytest

from tidemark.database import Database
from tidemark.errors import ColumnNotFound, EngineError, InvalidSchema, NotNullViolation, TableExists, TableNotFound, TransactionClosed, TypeMismatch, UniqueViolation
from tidemark.plans.expr import col
from tidemark.schema import TableBuilder
from .fixtures import crew, harbour, ids, table


def rows(db, name="sailors"):
    return {r["id"]: r for r in db.select("*").from_(name).exec()}


def test_builder_rules():
    with pytest.raises(InvalidSchema):
        TableBuilder("1x")
    with pytest.raises(InvalidSchema):
        TableBuilder("t").column("a", "Int64").column("a", "Int64")
    with pytest.raises(InvalidSchema):
        TableBuilder("t").column("a", "Decimal")
    with pytest.raises(ColumnNotFound):
        TableBuilder("t").column("a", "Int64").primary_key("b").build()
    with pytest.raises(InvalidSchema):
        TableBuilder("t").column("a", "Jsonb").index("i", "a").build()
    schema = TableBuilder("t").column("a", "Bytes").column("b", "String").build()
    assert [c.nullable for c in schema.columns] == [True, False]


def test_all_types(spark):
    db = Database(spark)
    kinds = ["Boolean", "Int32", "Int64", "Float64", "String", "DateTime", "Bytes", "Jsonb"]
    b = TableBuilder("t")
    for k in kinds:
        b.column(k.lower(), k, nullable=True)
    db.create_table(b)
    db.insert("t").values([{"boolean": 1, "int32": 3e9, "int64": 5.9, "float64": 2, "string": "é", "datetime": 1704067200000, "bytes": [1, 2, 255], "jsonb": {"b": 1, "a": None}}, {}]).exec()
    full, empty = sorted(db.select("*").from_("t").exec(), key=lambda r: r["int32"] is None)
    assert (full["boolean"], full["int32"], full["int64"], full["float64"], full["string"], bytes(full["bytes"]), full["jsonb"]) == (True, 2147483647, 5, 2.0, "é", b"\x01\x02\xff", '{"a":null,"b":1}')
    assert full["datetime"].replace(tzinfo=None) == dt.datetime(2024, 1, 1)
    assert set(empty.values()) == {None}
    assert db.select("string").from_("t").where(col("datetime").gte(1704067200000)).exec() == [{"string": "é"}]
    with pytest.raises(TypeMismatch):
        db.insert("t").values([{"int32": "x"}]).exec()


def test_catalog(spark):
    db = crew(spark)
    assert (db.has_table("sailors"), db.table_names(), db.table_count(), db.total_row_count()) == (True, ["sailors"], 1, 8)
    with pytest.raises(TableExists):
        db.create_table(TableBuilder("sailors").column("id", "Int64"))
    db.clear()
    assert db.total_row_count() == 0
    db.drop_table("sailors")
    with pytest.raises(TableNotFound):
        db.drop_table("sailors")


def test_insert_checks_leave_no_trace(spark):
    db = crew(spark)
    ok = {"id": 9, "name": "x", "years": 1, "ashore": True, "pay": 0}
    with pytest.raises(UniqueViolation):
        db.insert("sailors").values([ok, {**ok, "id": 1}]).exec()
    with pytest.raises(UniqueViolation):
        db.insert("sailors").values([ok, ok]).exec()
    with pytest.raises(NotNullViolation):
        db.insert("sailors").values([{**ok, "name": None}]).exec()
    with pytest.raises(ColumnNotFound):
        db.insert("sailors").values([{**ok, "mast": 1}]).exec()
    assert db.total_row_count() == 8
    assert db.insert("sailors").values([ok]).exec() == 1


def test_unique_index_ignores_nulls(spark):
    db = Database(spark)
    table(db, "t", [("id", "Int64"), ("code", "String", None)], [(1, "a"), (2, None), (3, None)], unique=[("by_code", "code")])
    with pytest.raises(UniqueViolation):
        db.insert("t").values([{"id": 4, "code": "a"}]).exec()
    with pytest.raises(UniqueViolation):
        db.update("t").set({"code": "a"}).where(col("id").eq(2)).exec()


def test_update_delete_upsert(spark):
    db = crew(spark)
    assert db.update("sailors").set("port", "X").where(col("port").eq("Lisboa")).exec() == 2
    assert db.update("sailors").set({"years": col("years") + 1}).where(col("port").is_null()).exec() == 1
    assert (rows(db)[1]["port"], rows(db)[6]["years"]) == ("X", 5)
    with pytest.raises(NotNullViolation):
        db.update("sailors").set({"name": None}).exec()
    assert db.delete("sailors").where(col("port").ne("X")).exec() == 5  # NULL stays
    assert ids(db.select("id").from_("sailors").exec()) == [1, 3, 6]
    new = {"name": "New", "years": 1, "ashore": False, "pay": 0}
    db.insert_or_replace("sailors", [{"id": 1, **new}, {"id": 20, **new}])
    assert (rows(db)[1]["name"], len(rows(db))) == ("New", 4)
    assert db.delete("sailors").exec() == 4


def test_updates_never_raise_on_a_value_out_of_range(spark):
    db = crew(spark)
    db.update("sailors").set({"years": col("pay") * 1e10}).where(col("id").eq(1)).exec()
    db.update("sailors").set({"years": col("pay") * -1e10}).where(col("id").eq(2)).exec()
    db.update("sailors").set({"years": col("pay")}).where(col("id").eq(3)).exec()
    assert [rows(db)[i]["years"] for i in (1, 2, 3)] == [2147483647, -2147483648, 27]


def scans(frame):
    """Leaves of a frame's plan."""
    return str(frame._jdf.queryExecution().optimizedPlan().collectLeaves().size())


def test_updates_read_the_table_once(spark):
    db = crew(spark)
    tx = db.transaction()
    for i in range(20):
        tx.update("sailors", {"years": col("years") + 1, "pay": col("pay") + 0.5}, col("id").gt(i % 8))
        assert scans(tx.table("sailors")) <= "2"  # the rows of the first insert and none
    tx.commit()
    assert scans(db.table("sailors")) == "1"
    assert (rows(db)[8]["years"], rows(db)[1]["years"]) == (29, 15)


def test_paged_changes_go_by_key(spark):
    from tidemark.operators import dml

    db = crew(spark)
    now = db.table("sailors")
    target = now.orderBy("years", "id").limit(2)
    change = dml.update(db.schema("sailors"), now, {"name": "few"}, None, target)
    assert sorted((r.id, r.name) for r in change.after.collect() if r.name == "few") == [(2, "few"), (6, "few")]
    assert change.count == 2 and change.after.count() == 8
    change = dml.delete(db.schema("sailors"), now, None, target)
    assert ids(r.asDict() for r in change.after.collect()) == [1, 3, 4, 5, 7, 8]


def test_many_changes_are_compacted(spark):
    db = crew(spark)
    for i in range(12):
        db.update("sailors").set({"years": i}).where(col("id").eq(1)).exec()
    assert rows(db)[1]["years"] == 11


def test_transactions(spark):
    db = crew(spark)
    tx = db.transaction()
    tx.delete("sailors", col("id").gt(1))
    tx.update("sailors", {"name": "T"}, col("id").eq(1))
    assert db.total_row_count() == 8
    tx.rollback()
    assert db.total_row_count() == 8
    with pytest.raises(TransactionClosed):
        tx.commit()
    extra = {"id": 9, "name": "Extra", "years": 1, "ashore": True, "pay": 1}
    with db.transaction() as tx:
        tx.insert("sailors").values([extra]).exec()
        tx.delete("sailors", col("id").eq(1))
    assert ids(db.select("id").from_("sailors").exec()) == [2, 3, 4, 5, 6, 7, 8, 9]
    with pytest.raises(UniqueViolation):
        with db.transaction() as tx:
            tx.delete("sailors")
            tx.insert("sailors", [extra] * 2)
    assert db.total_row_count() == 8
    one, two = db.transaction(), db.transaction()
    one.delete("sailors", col("id").eq(2))
    two.delete("sailors", col("id").eq(3))
    one.commit()
    with pytest.raises(EngineError):
        two.commit()


def test_foreign_key_validator(spark):
    db = harbour(spark)
    assert db.broken_foreign_keys() == []
    db.delete("ships").where(col("id").eq(2)).exec()
    assert db.broken_foreign_keys() == ["by_ship"]

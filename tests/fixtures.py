"""Small tables with NULLs, missing join partners, JSON nulls and text that is no JSON."""

import json

from tidemark.database import Database
from tidemark.schema import TableBuilder


def table(db, name, columns, rows, key="id", **more):
    b = TableBuilder(name)
    for c in columns:
        b.column(*c[:2], nullable=len(c) > 2)
    b.primary_key(key)
    for fk in more.get("foreign", ()):
        b.foreign_key(*fk)
    for unique in more.get("unique", ()):
        b.unique_index(*unique)
    schema = db.create_table(b)
    if rows:
        db.insert(name).values([dict(zip(schema.names, r)) for r in rows]).exec()
    return schema


#: id, name, years at sea, ashore, pay, port
SAILORS = [
    (1, "Ines", 12, False, 31.5, "Lisboa"),
    (2, "Tomas", 4, True, 18.25, "Porto"),
    (3, "Maren", 12, False, 27.0, "Lisboa"),
    (4, "Oluf", 21, True, 44.0, "Bergen"),
    (5, "Yuki", 9, False, 22.75, "Porto"),
    (6, "Dario", 4, True, 18.25, None),
    (7, "Sanna", 16, False, 35.0, "Bremen"),
    (8, "Pell", 9, True, 20.5, "Bergen"),
]


def crew(spark):
    db = Database(spark)
    table(db, "sailors", [("id", "Int64"), ("name", "String"), ("years", "Int32"), ("ashore", "Boolean"), ("pay", "Float64"), ("port", "String", None)], SAILORS)
    return db


def harbour(spark):
    """Ship 3 makes no trip; trips 21, 24 and 25 owe no dues."""
    db = Database(spark)
    table(db, "ships", [("id", "Int64"), ("name", "String")], [(1, "Alba"), (2, "Brisa"), (3, "Corvo"), (4, "Dorsal")])
    table(db, "trips", [("id", "Int64"), ("ship_id", "Int64"), ("tons", "Int64")], [(21, 1, 40), (22, 1, 75), (23, 2, 60), (24, 4, 60), (25, 1, 5)], foreign=[("by_ship", "ship_id", "ships", "id", "ship", "trips")])
    table(db, "dues", [("id", "Int64"), ("trip_id", "Int64"), ("kind", "String"), ("paid", "Boolean")], [(301, 22, "pilot", True), (302, 23, "berth", False), (303, 22, "berth", True)])
    return db


def ranks(spark):
    db = Database(spark)
    table(db, "ranks", [("id", "Int64"), ("name", "String"), ("above", "Int64", None)], [(1, "captain", None), (2, "mate", 1), (3, "cook", 1), (4, "boy", 2)])
    return db


DEPTHS = [(1, "north", 3), (2, "north", 12), (3, "south", 6), (4, "south", 6), (5, "south", 3)]


def gauges(spark):
    db = Database(spark)
    table(db, "gauges", [("id", "Int64"), ("place", "String"), ("depth", "Int64", None)], DEPTHS)
    return db


def charts(spark):
    db = Database(spark)
    notes = [
        (1, "Estuary", {"kinds": ["depth", "wrecks"], "drawn": {"by": "Noor"}, "scale": "fine"}),
        (2, "Open sea", {"kinds": ["routes"], "drawn": {"by": "Iker"}, "scale": "coarse"}),
        (3, "Old harbour", {"kinds": ["walls", "wrecks"], "drawn": None, "scale": "fine"}),
    ]
    table(db, "charts", [("id", "Int64"), ("title", "String"), ("notes", "Jsonb", None)], [(i, t, json.dumps(m)) for i, t, m in notes] + [(4, "Torn", "[1,"), (5, "Blank", None)])
    return db


def ids(rows):
    return sorted(r["id"] for r in rows)

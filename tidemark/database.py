"""The database: named tables, queries, mutations, transactions and live queries."""

from __future__ import annotations

from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import EngineError, TableExists, TableNotFound, TransactionClosed
from .operators import dml
from .plans.builder import Select
from .plans.expr import Expr, Field
from .schema import TableBuilder, TableSchema, inferred
from .sources.store import checkpointed
from .streaming.live import LiveRegistry

#: A table whose rows have gone through this many changes is cut off from their lineage.
COMPACT_EVERY = 6


class Database:
    """Tables are immutable snapshots; a mutation replaces a table's snapshot by a new one."""

    def __init__(self, spark: SparkSession, name: str = "db"):
        self.spark, self.name = spark, name
        self._tables: dict[str, DataFrame] = {}
        self._schemas: dict[str, TableSchema] = {}
        self._depth: dict[str, int] = {}
        self._held: tuple | None = None
        self.live = LiveRegistry(self)

    # ---- catalog
    @staticmethod
    def table_builder(name: str) -> TableBuilder:
        return TableBuilder(name)

    def create_table(self, schema: TableSchema | TableBuilder) -> TableSchema:
        schema = schema.build() if isinstance(schema, TableBuilder) else schema
        return self.register_table(self.spark.createDataFrame([], schema.struct), schema)

    def register_table(self, rows: DataFrame, schema: TableSchema | str) -> TableSchema:
        """Make a DataFrame a table; with a name alone the schema is inferred."""
        schema = inferred(schema, rows.schema) if isinstance(schema, str) else schema
        if schema.name in self._tables:
            raise TableExists(schema.name)
        self._tables[schema.name], self._schemas[schema.name], self._depth[schema.name] = rows, schema, 0
        return schema

    def drop_table(self, name: str) -> None:
        self._known(name)
        del self._tables[name], self._schemas[name], self._depth[name]

    def clear_table(self, name: str) -> None:
        self.delete(name).exec()

    def clear(self) -> None:
        for name in list(self._tables):
            self.clear_table(name)

    def has_table(self, name: str) -> bool:
        return name in self._tables

    def table_names(self) -> list[str]:
        return list(self._tables)

    def table_count(self) -> int:
        return len(self._tables)

    def total_row_count(self) -> int:
        return sum(t.count() for t in self._tables.values())

    def schema(self, name: str) -> TableSchema:
        self._known(name)
        return self._schemas[name]

    def schemas(self) -> dict[str, TableSchema]:
        return dict(self._schemas)

    def _known(self, name: str) -> None:
        if name not in self._tables:
            raise TableNotFound(name)

    def table(self, name: str) -> DataFrame:
        self._known(name)
        return self._tables[name]

    def snapshot(self) -> _Snapshot:
        return _Snapshot(self._tables)

    def fields(self, table: str, alias: str) -> list[Field]:
        kinds = {c.name: c.type for c in self.schema(table).columns}
        return [Field(alias, f.name, f.dataType.simpleString(), kinds.get(f.name)) for f in self.table(table).schema.fields]

    # ---- queries and mutations
    def select(self, *columns) -> Select:
        return Select(self, columns)

    def insert(self, table: str) -> Insert:
        return Insert(self, table)

    def update(self, table: str) -> Update:
        return Update(self, table)

    def delete(self, table: str) -> Delete:
        return Delete(self, table)

    def insert_or_replace(self, table: str, rows: list[dict] | DataFrame) -> int:
        return self.apply(table, dml.upsert(self.spark, self.schema(table), self.table(table), rows))

    def transaction(self) -> Transaction:
        return Transaction(self)

    def broken_foreign_keys(self) -> list[str]:
        return dml.check_foreign_keys(self._schemas, self._tables)

    def apply(self, table: str, change: dml.Change) -> int:
        self.swap({table: change.after}, {table: [change]})
        return change.count

    def apply_delta(self, table: str, delta: DataFrame) -> None:
        """Apply a Z-set of rows (the table's columns and ``_d``) from a change log.

        With a primary key the table is only joined with the keys of removed rows; without
        one its rows have to be counted."""
        from .streaming import zset

        key, rows = self.schema(table).primary_key, self.table(table)
        delta = checkpointed(zset.consolidate(delta))
        added, removed = zset.rows(delta.where("_d > 0")), zset.rows(delta.where("_d < 0").withColumn("_d", -F.col("_d")))
        if key:
            gone = removed.select(*[F.col(f"`{k}`").alias(f"key {i}") for i, k in enumerate(key)])
            same = [F.col(f"`{k}`") == F.col(f"key {i}") for i, k in enumerate(key)]
            after = rows.join(gone, same, "left_anti").unionByName(added)
        else:
            after = zset.rows(zset.consolidate(zset.weighted(rows).unionByName(delta)))
        self.swap({table: after}, {table: [dml.Change(after, added, removed, 0)]})

    def depth(self, table: str) -> int:
        """Changes that the plan of a table's rows goes through."""
        return self._depth[table]

    def swap(self, after: dict[str, DataFrame], changes: dict[str, list[dml.Change]], depth: dict[str, int] | None = None) -> None:
        """Make new snapshots current and tell live queries, once for all tables.

        ``depth``: of the new snapshots, where a transaction has compacted them itself."""
        before = self.snapshot()
        for name, rows in after.items():
            self._depth[name] = depth[name] if depth else self._depth[name] + len(changes.get(name, ()))
            if self._depth[name] >= COMPACT_EVERY:
                rows, self._depth[name] = checkpointed(rows), 0
            self._tables[name] = rows
        if self._held is not None:
            for name, made in changes.items():
                self._held[1].setdefault(name, []).extend(made)
        else:
            self.live.publish(before, self.snapshot(), changes)

    @contextmanager
    def batched(self):
        """Live queries hear of all changes made inside at once, when the block ends."""
        if self._held is not None:
            yield self
            return
        self._held = (self.snapshot(), {})
        try:
            yield self
        finally:
            (before, changes), self._held = self._held, None
            if changes:
                self.live.publish(before, self.snapshot(), changes)

    # ---- GraphQL
    def graphql_schema(self) -> str:
        from .gql.catalog import Catalog

        return Catalog(self._schemas).sdl()

    def graphql(self, document: str, variables: dict | None = None, operation: str | None = None) -> dict:
        return self.prepare_graphql(document).exec(variables, operation)

    def prepare_graphql(self, document: str):
        from .gql.execute import PreparedDocument

        return PreparedDocument(self, document)

    def subscribe_graphql(self, document: str, variables: dict | None = None, operation: str | None = None):
        return self.prepare_graphql(document).subscribe(variables, operation)


class _Snapshot(dict):
    def __init__(self, tables: dict[str, DataFrame]):
        super().__init__(tables)

    def __missing__(self, name):
        raise TableNotFound(name)


class Insert:
    def __init__(self, target, table: str):
        self.target, self.table, self.rows = target, table, []

    def values(self, rows: list[dict] | dict | DataFrame) -> Insert:
        self.rows = [rows] if isinstance(rows, dict) else rows
        return self

    def exec(self) -> int:
        t = self.target
        return t.apply(self.table, dml.insert(t.spark, t.schema(self.table), t.table(self.table), self.rows))


class Update:
    def __init__(self, target, table: str):
        self.target, self.table, self.changes, self.condition = target, table, {}, None

    def set(self, values: dict[str, Any] | str, value: Any = None) -> Update:
        self.changes |= values if isinstance(values, dict) else {values: value}
        return self

    def where(self, condition: Expr) -> Update:
        self.condition = condition if self.condition is None else self.condition & condition
        return self

    def exec(self) -> int:
        t = self.target
        return t.apply(self.table, dml.update(t.schema(self.table), t.table(self.table), self.changes, self.condition))


class Delete:
    def __init__(self, target, table: str):
        self.target, self.table, self.condition = target, table, None

    def where(self, condition: Expr) -> Delete:
        self.condition = condition if self.condition is None else self.condition & condition
        return self

    def exec(self) -> int:
        t = self.target
        return t.apply(self.table, dml.delete(t.schema(self.table), t.table(self.table), self.condition))


class Transaction:
    """Works on snapshots of its own; commit makes them current at once, rollback drops them.

    A commit after someone else changed one of its tables is refused."""

    def __init__(self, db: Database):
        self.db, self.spark = db, db.spark
        self._begin = db.snapshot()
        self._tables = dict(self._begin)
        self._changes: dict[str, list[dml.Change]] = {}
        self._depth: dict[str, int] = {}
        self.state = "active"

    def _open(self) -> None:
        if self.state != "active":
            raise TransactionClosed(self.state)

    def schema(self, name: str) -> TableSchema:
        return self.db.schema(name)

    def snapshot(self) -> _Snapshot:
        return _Snapshot(self._tables)

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise TableNotFound(name)
        return self._tables[name]

    def apply(self, table: str, change: dml.Change) -> int:
        self._open()
        rows = change.after
        self._depth[table] = self._depth.get(table, self.db.depth(table)) + 1
        if self._depth[table] >= COMPACT_EVERY:
            rows, self._depth[table] = checkpointed(rows), 0
        self._tables[table] = rows
        self._changes.setdefault(table, []).append(change)
        return change.count

    def insert(self, table: str, rows: list[dict] | DataFrame | None = None):
        self._open()
        made = Insert(self, table)
        return made if rows is None else made.values(rows).exec()

    def update(self, table: str, values: dict | None = None, where: Expr | None = None):
        self._open()
        made = Update(self, table)
        if values is None:
            return made
        return (made.set(values).where(where) if where is not None else made.set(values)).exec()

    def delete(self, table: str, where: Expr | None = None) -> int:
        """Delete the rows that satisfy the condition, or all."""
        self._open()
        made = Delete(self, table)
        return (made.where(where) if where is not None else made).exec()

    def commit(self) -> None:
        self._open()
        current = self.db.snapshot()
        for name in self._changes:
            if name not in current or current[name] is not self._begin[name]:
                raise EngineError(f"{name} was changed by another transaction")
        self.state = "committed"
        self.db.swap({n: self._tables[n] for n in self._changes}, self._changes, self._depth)

    def rollback(self) -> None:
        self._open()
        self.state = "rolled back"

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *_) -> None:
        if self.state == "active":
            self.rollback() if kind else self.commit()

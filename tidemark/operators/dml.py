"""Insert, update, delete and upsert as pure functions on snapshots.

Each takes a schema and the current rows and returns a Change: the new rows, and what
was added and removed. Nothing is stored here, so a batch that fails leaves no trace.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ColumnNotFound, NotNullViolation, UniqueViolation
from ..functions.scalar import fitted
from ..plans.expr import Expr, Field, Scope
from ..schema import TableSchema, coerce
from ..sources.store import checkpointed


@dataclass(frozen=True)
class Change:
    after: DataFrame
    added: DataFrame
    removed: DataFrame
    count: int


def scope_of(schema: TableSchema, table: str | None = None) -> Scope:
    return Scope([Field("", c.name, c.spark_type.simpleString(), c.type) for c in schema.columns])


def rows_frame(spark: SparkSession, schema: TableSchema, rows: list[dict] | DataFrame, current: DataFrame) -> DataFrame:
    """Rows to insert as a DataFrame with the types of the table."""
    kinds = {f.name: f.dataType for f in current.schema.fields}
    if not isinstance(rows, DataFrame):
        rows = spark.createDataFrame([schema.row(r) for r in rows], schema.struct)
    unknown = set(rows.columns) - set(schema.names)
    if unknown:
        raise ColumnNotFound(f"{schema.name}: {', '.join(sorted(unknown))}")
    missing = [c for c in schema.columns if c.name not in rows.columns]
    rows = rows.withColumns({c.name: F.lit(c.default) for c in missing}) if missing else rows
    given = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*[_fitted(F.col(f"`{c.name}`"), given[c.name], kinds[c.name]).alias(c.name) for c in schema.columns])


def _fitted(c, kind: str, wanted):
    """A column in a table's type; it never raises."""
    return fitted(c, kind, wanted.simpleString())


def _keys(schema: TableSchema, rows: DataFrame) -> list | None:
    """The primary key of rows under names of its own, or None without a key."""
    return [F.col(f"`{k}`").alias(f"key {i}") for i, k in enumerate(schema.primary_key)] or None


def _same_key(schema: TableSchema):
    condition = F.lit(True)
    for i, k in enumerate(schema.primary_key):
        condition = condition & (F.col(f"`{k}`") == F.col(f"`key {i}`"))
    return condition


def check_not_null(schema: TableSchema, rows: DataFrame) -> None:
    strict = [c.name for c in schema.columns if not c.nullable]
    if not strict:
        return
    counts = rows.agg(*[F.count_if(F.col(f"`{n}`").isNull()).alias(n) for n in strict]).first()
    for n in strict:
        if counts[n]:
            raise NotNullViolation(f"Column {n} is not nullable")


def check_unique(schema: TableSchema, rows: DataFrame, existing: DataFrame | None) -> None:
    """No key of ``rows`` occurs twice, or in ``existing``; keys with a NULL are never equal."""
    for name, key in schema.keys():
        columns = [F.col(f"`{k}`") for k in key]
        keyed = rows.dropna(subset=list(key)).select(*columns)
        twice = keyed.groupBy(*columns).count().where("count > 1").limit(1)
        if twice.count() or (existing is not None and keyed.join(existing.select(*columns), list(key), "left_semi").limit(1).count()):
            raise UniqueViolation(f"{schema.name}.{name} ({', '.join(key)})")


def insert(spark: SparkSession, schema: TableSchema, current: DataFrame, rows: list[dict] | DataFrame) -> Change:
    new = rows_frame(spark, schema, rows, current)
    check_not_null(schema, new)
    check_unique(schema, new, current)
    return Change(current.unionByName(new), new, current.limit(0), new.count())


def upsert(spark: SparkSession, schema: TableSchema, current: DataFrame, rows: list[dict] | DataFrame) -> Change:
    """Insert or replace by primary key."""
    new = rows_frame(spark, schema, rows, current)
    check_not_null(schema, new)
    check_unique(schema, new, None)
    key = list(schema.primary_key)
    rest = current.join(new.select(*key), key, "left_anti").select(*current.columns)
    gone = current.join(new.select(*key), key, "left_semi").select(*current.columns)
    check_unique(schema, new, rest)
    return Change(rest.unionByName(new), new, gone, new.count())


def _holds(schema: TableSchema, where: Expr | None):
    return F.lit(True) if where is None else F.coalesce(where.column(scope_of(schema)), F.lit(False))


HIT = "row is hit"


def _marked(schema: TableSchema, current: DataFrame, where: Expr | None, target: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``current`` with a column that marks the rows to change, and these rows alone.

    A condition is one pass over the table; rows given outright are found by their primary
    key, so the table is shuffled at most by that (and not at all while they are few)."""
    if target is None:
        holds = _holds(schema, where)
        return current.withColumn(HIT, holds), current.where(holds)
    # Which rows a limit takes may change from run to run: the choice is kept.
    target = checkpointed(target.select(*current.columns))
    keys = target.select(*_keys(schema, target)).withColumn("found", F.lit(True))
    joined = current.join(keys, _same_key(schema), "left")
    return joined.select(*current.columns, F.coalesce("found", F.lit(False)).alias(HIT)), target


def update(schema: TableSchema, current: DataFrame, values: dict[str, Any], where: Expr | None, target: DataFrame | None = None) -> Change:
    """Set columns to values or expressions on the rows that satisfy the condition.

    The new table is one pass over the old one, so updates after each other do not read it
    more often. ``target``: the rows to change, given outright (they are rows of ``current``)."""
    scope, kinds = scope_of(schema), {f.name: f.dataType for f in current.schema.fields}
    made = {}
    for name, value in values.items():
        column = schema.column(name)
        new, kind = value.compile(scope) if isinstance(value, Expr) else (F.lit(coerce(value, column)), None)
        made[name] = _fitted(new, kind, kinds[name]) if kind else new.cast(kinds[name])
    if target is not None and not schema.primary_key:
        old, rest = target, current.exceptAll(target)
        new = old.select(*[(made[c] if c in made else F.col(f"`{c}`")).alias(c) for c in current.columns])
        after = rest.unionByName(new)
    else:
        marked, old = _marked(schema, current, where, target)
        after = marked.select(*[(F.when(F.col(f"`{HIT}`"), made[c]).otherwise(F.col(f"`{c}`")) if c in made else F.col(f"`{c}`")).alias(c) for c in current.columns])
        new = old.select(*[(made[c] if c in made else F.col(f"`{c}`")).alias(c) for c in current.columns])
        rest = marked.where(~F.col(f"`{HIT}`"))
    check_not_null(schema, new)
    if any(n in key for _, key in schema.keys() for n in values):
        check_unique(schema, new, rest)
    return Change(after, new, old, old.count())


def delete(schema: TableSchema, current: DataFrame, where: Expr | None, target: DataFrame | None = None) -> Change:
    if target is not None and not schema.primary_key:
        return Change(current.exceptAll(target), current.limit(0), target, target.count())
    if target is None:
        holds = _holds(schema, where)
        gone = current.where(holds)
        return Change(current.where(~holds), current.limit(0), gone, gone.count())
    target = checkpointed(target.select(*current.columns))
    after = current.join(target.select(*_keys(schema, target)), _same_key(schema), "left_anti")
    return Change(after, current.limit(0), target, target.count())


def check_foreign_keys(schemas: dict[str, TableSchema], tables: dict[str, DataFrame]) -> list[str]:
    """Names of the foreign keys with a value that no parent row has (a validator; DML does not call it)."""
    broken = []
    for schema in schemas.values():
        for fk in schema.foreign_keys:
            child = tables[schema.name].where(F.col(fk.column).isNotNull()).select(F.col(fk.column).alias("k"))
            parent = tables[fk.parent_table].select(F.col(fk.parent_column).alias("k"))
            if child.join(parent, "k", "left_anti").limit(1).count():
                broken.append(fk.name)
    return broken

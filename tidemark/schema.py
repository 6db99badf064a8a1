"""Types, table schemas and their builder."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from .errors import ColumnNotFound, InvalidSchema, NotNullViolation, TypeMismatch

#: The engine's eight column types and their Spark types. Jsonb holds JSON text.
SPARK_TYPES = {
    "Boolean": T.BooleanType(),
    "Int32": T.IntegerType(),
    "Int64": T.LongType(),
    "Float64": T.DoubleType(),
    "String": T.StringType(),
    "DateTime": T.TimestampType(),
    "Bytes": T.BinaryType(),
    "Jsonb": T.StringType(),
}
NULLABLE_BY_DEFAULT = ("Bytes", "Jsonb")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = False
    default: Any = None

    @property
    def spark_type(self) -> T.DataType:
        return SPARK_TYPES[self.type]


@dataclass(frozen=True)
class ForeignKey:
    name: str
    column: str
    parent_table: str
    parent_column: str
    forward_name: str | None = None
    reverse_name: str | None = None
    on_delete: str = "restrict"


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, tuple[str, ...]], ...] = ()
    indexes: tuple[tuple[str, tuple[str, ...], str], ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise ColumnNotFound(f"{self.name}.{name}")

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, True, {"type": c.type}) for c in self.columns])

    def keys(self) -> list[tuple[str, tuple[str, ...]]]:
        """(name, columns) of the primary key and all unique indexes."""
        own = [(f"pk{self.name[:1].upper()}{self.name[1:]}", self.primary_key)] if self.primary_key else []
        return own + list(self.unique)

    def row(self, values: dict) -> tuple:
        """A row of Spark values; missing columns take their default."""
        unknown = set(values) - set(self.names)
        if unknown:
            raise ColumnNotFound(f"{self.name}: {', '.join(sorted(unknown))}")
        out = []
        for c in self.columns:
            value = values.get(c.name, c.default)
            if value is None and not c.nullable:
                raise NotNullViolation(f"Column {c.name} is not nullable")
            out.append(coerce(value, c))
        return tuple(out)


def coerce(value: Any, column: Column) -> Any:
    """A host value as the column's Spark value.

    Integers come from whole or fractional numbers (cut towards zero, clamped to the
    type's range); DateTime from milliseconds since the epoch or datetimes; Bytes from
    bytes or lists of integers; Jsonb from JSON text or plain structures."""
    import json

    if value is None:
        return None
    kind = column.type
    try:
        if kind == "Boolean":
            return bool(value)
        if kind in ("Int32", "Int64"):
            bits = 31 if kind == "Int32" else 63
            return max(-(1 << bits), min((1 << bits) - 1, int(value)))
        if kind == "Float64":
            return float(value)
        if kind == "String":
            return str(value)
        if kind == "DateTime":
            if isinstance(value, dt.datetime):
                return value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
            return EPOCH + dt.timedelta(milliseconds=int(value))
        if kind == "Bytes":
            return bytearray(value.encode() if isinstance(value, str) else bytes(value))
        return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), sort_keys=True)
    except (TypeError, ValueError, OverflowError) as e:
        raise TypeMismatch(f"{column.name}: {value!r} is no {kind}") from e


@dataclass
class TableBuilder:
    """Builds a TableSchema step by step; every method returns the builder."""

    name: str
    _columns: list[Column] = field(default_factory=list)
    _primary: tuple[str, ...] = ()
    _unique: list = field(default_factory=list)
    _indexes: list = field(default_factory=list)
    _foreign: list = field(default_factory=list)

    def __post_init__(self):
        self._check(self.name)

    @staticmethod
    def _check(name: str) -> None:
        if not NAME.match(name):
            raise InvalidSchema(f"invalid name: {name!r}")

    def column(self, name: str, kind: str, nullable: bool | None = None, primary_key: bool = False, unique: bool = False, default: Any = None) -> TableBuilder:
        self._check(name)
        if kind not in SPARK_TYPES:
            raise InvalidSchema(f"unknown type {kind}")
        if any(c.name == name for c in self._columns):
            raise InvalidSchema(f"duplicate column {name}")
        self._columns.append(Column(name, kind, kind in NULLABLE_BY_DEFAULT if nullable is None else nullable, default))
        if primary_key:
            self._primary = (*self._primary, name)
        if unique:
            self.unique_index(f"uq_{name}", name)
        return self

    def primary_key(self, *names: str) -> TableBuilder:
        self._primary = names
        return self

    def unique_index(self, name: str, *columns: str) -> TableBuilder:
        self._unique.append((name, columns))
        return self

    def index(self, name: str, *columns: str, kind: str = "BTree") -> TableBuilder:
        """Recorded for introspection; Parquet statistics and Catalyst take the place of access paths."""
        self._indexes.append((name, columns, kind))
        return self

    def foreign_key(self, name: str, column: str, parent_table: str, parent_column: str, forward_name=None, reverse_name=None, on_delete="restrict") -> TableBuilder:
        self._foreign.append(ForeignKey(name, column, parent_table, parent_column, forward_name, reverse_name, on_delete))
        return self

    def build(self) -> TableSchema:
        names = [c.name for c in self._columns]
        if not names:
            raise InvalidSchema(f"table {self.name} has no columns")
        used = [*self._primary, *(c for _, cols in self._unique for c in cols), *(c for _, cols, _ in self._indexes for c in cols), *(f.column for f in self._foreign)]
        for c in used:
            if c not in names:
                raise ColumnNotFound(f"{self.name}.{c}")
        by_name = {c.name: c for c in self._columns}
        for c in [*self._primary, *(c for _, cols, kind in self._indexes if kind == "BTree" for c in cols)]:
            if by_name[c].type in ("Bytes", "Jsonb"):
                raise InvalidSchema(f"column {c} of type {by_name[c].type} cannot be indexed")
        columns = tuple(Column(c.name, c.type, c.nullable and c.name not in self._primary, c.default) for c in self._columns)
        return TableSchema(self.name, columns, tuple(self._primary), tuple(self._unique), tuple(self._indexes), tuple(self._foreign))


def inferred(name: str, struct: T.StructType) -> TableSchema:
    """A schema for a DataFrame that is registered as a table."""
    kinds = {"boolean": "Boolean", "tinyint": "Int32", "smallint": "Int32", "int": "Int32", "bigint": "Int64", "float": "Float64", "double": "Float64", "string": "String", "timestamp": "DateTime", "timestamp_ntz": "DateTime", "date": "DateTime", "binary": "Bytes"}
    return TableSchema(name, tuple(Column(f.name, kinds.get(f.dataType.simpleString(), "Jsonb"), True) for f in struct.fields))

"""The logical plan: a small tree that compiles to a DataFrame.

``frame(tables)`` gives the rows for a set of table snapshots, so the same tree runs on
any state: the current one, a transaction's, or both sides of a change.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TypeMismatch
from ..functions import aggregates
from .expr import Expr, Field, Scope

Tables = dict[str, DataFrame]


class Node:
    inputs: tuple[Node, ...] = ()

    @property
    def scope(self) -> Scope:
        raise NotImplementedError

    def build(self, *frames: DataFrame) -> DataFrame:
        """The operator on its inputs' rows."""
        raise NotImplementedError

    def frame(self, tables: Tables) -> DataFrame:
        return self.build(*[n.frame(tables) for n in self.inputs])

    @property
    def tables(self) -> set[str]:
        return set().union(*[n.tables for n in self.inputs])


@dataclass(frozen=True, eq=False)
class Scan(Node):
    table: str
    alias: str
    fields: tuple[Field, ...]

    @property
    def scope(self):
        return Scope(list(self.fields))

    def frame(self, tables):
        return self.renamed(tables[self.table])

    def renamed(self, df: DataFrame, *more: str) -> DataFrame:
        return df.select(*[F.col(f"`{f.name}`").alias(f.full) for f in self.fields], *more)

    @property
    def tables(self):
        return {self.table}


@dataclass(frozen=True, eq=False)
class Filter(Node):
    input: Node
    condition: Expr

    @property
    def inputs(self):
        return (self.input,)

    @property
    def scope(self):
        return self.input.scope

    def build(self, df):
        return df.where(self.condition.column(self.scope))


@dataclass(frozen=True, eq=False)
class Join(Node):
    """kind: inner, left, right, full or cross; ``current``: the table a bare name of the condition means first."""

    left: Node
    right: Node
    kind: str
    condition: Expr | None
    current: str = ""

    @property
    def inputs(self):
        return (self.left, self.right)

    @cached_property
    def scope(self):
        return Scope(self.left.scope.fields + self.right.scope.fields)

    def on(self):
        return self.condition.column(self.scope.preferring(self.current))

    def build(self, left, right):
        if self.kind == "cross" or self.condition is None:
            return left.crossJoin(right)
        return left.join(right, self.on(), self.kind)

    def equal_names(self) -> tuple[str, str] | None:
        """The columns of an equality between both sides, bare or joined to others by AND."""
        from .expr import Comparison, Logic, Name

        scope, left = self.scope.preferring(self.current), self.left.scope.by_full
        todo = [self.condition]
        while todo:
            c = todo.pop(0)
            if isinstance(c, Logic) and c.op == "and":
                todo += [c.left, c.right]
            if isinstance(c, Comparison) and c.op == "=" and isinstance(c.left, Name) and isinstance(c.right, Name):
                a, b = scope.find(c.left.name).full, scope.find(c.right.name).full
                if (a in left) != (b in left):
                    return (a, b) if a in left else (b, a)
        return None


@dataclass(frozen=True, eq=False)
class Project(Node):
    """outputs: (expression, name); the results stand without a table."""

    input: Node
    outputs: tuple[tuple[Expr, str], ...]

    @property
    def inputs(self):
        return (self.input,)

    @cached_property
    def scope(self):
        return Scope([Field("", name, e.compile(self.input.scope)[1]) for e, name in self.outputs])

    def build(self, df, *more: str):
        return df.select(*[e.column(self.input.scope).alias(name) for e, name in self.outputs], *more)


@dataclass(frozen=True, eq=False)
class Aggregate(Node):
    """keys: (field of the input, name); calls: (function, field or None, name)."""

    input: Node
    keys: tuple[tuple[Field, str], ...]
    calls: tuple[tuple[str, Field | None, str], ...]

    @property
    def inputs(self):
        return (self.input,)

    @cached_property
    def scope(self):
        own = [Field("", name, f.spark_type) for f, name in self.keys]
        for func, f, name in self.calls:
            kind = f.spark_type if f else "bigint"
            if func in ("count", "distinct"):
                kind = "bigint"
            elif func == "sum":
                kind = "double" if kind in ("double", "float") else "bigint"
            elif func in ("avg", "stddev", "geomean"):
                kind = "double"
            own.append(Field("", name, kind))
        return Scope(own)

    def build(self, df):
        calls = [aggregates.aggregate(func, f.column if f else None, f.spark_type if f else "bigint").alias(name) for func, f, name in self.calls]
        keys = [f.column.alias(name) for f, name in self.keys]
        if not calls:
            return df.select(*keys).distinct()
        return df.groupBy(*keys).agg(*calls) if keys else df.agg(*calls)


@dataclass(frozen=True, eq=False)
class Union(Node):
    left: Node
    right: Node
    distinct: bool

    def __post_init__(self):
        a, b = ([f.spark_type for f in n.scope.fields] for n in (self.left, self.right))
        if a != b:
            raise TypeMismatch(f"union of {a} and {b}")

    @property
    def inputs(self):
        return (self.left, self.right)

    @property
    def scope(self):
        return self.left.scope

    def build(self, left, right):
        both = left.union(right)
        return both.distinct() if self.distinct else both


@dataclass(frozen=True, eq=False)
class Sort(Node):
    """orders: (expression, ascending); NULLs lowest."""

    input: Node
    orders: tuple[tuple[Expr, bool], ...]

    @property
    def inputs(self):
        return (self.input,)

    @property
    def scope(self):
        return self.input.scope

    def build(self, df):
        columns = [(e.column(self.scope), up) for e, up in self.orders]
        return df.orderBy(*[c.asc_nulls_first() if up else c.desc_nulls_last() for c, up in columns])


@dataclass(frozen=True, eq=False)
class Limit(Node):
    input: Node
    limit: int | None
    offset: int

    @property
    def inputs(self):
        return (self.input,)

    @property
    def scope(self):
        return self.input.scope

    def build(self, df):
        if self.offset:
            df = df.offset(self.offset)
        return df if self.limit is None else df.limit(self.limit)


@dataclass(frozen=True, eq=False)
class Empty(Node):
    """No rows, with the columns of a scope."""

    fields: tuple[Field, ...]

    @property
    def scope(self):
        return Scope(list(self.fields))

    @property
    def tables(self):
        return set()

    def frame(self, tables):
        from pyspark.sql import SparkSession

        ddl = ", ".join(f"`{f.full}` {f.spark_type}" for f in self.fields)
        return SparkSession.getActiveSession().createDataFrame([], ddl)

"""Expressions of queries, compiled to Columns against a scope.

A scope maps names to columns: ``table.column`` exactly, a bare name to the first
table of the scope that has it. Inside a plan every column is called ``table.column``,
so names never clash.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ColumnNotFound
from ..functions import jsonpath, predicates, scalar


@dataclass(frozen=True)
class Field:
    """A column in scope."""

    table: str
    name: str
    spark_type: str
    kind: str | None = None  # the schema's type, where it is known

    @property
    def full(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name

    @property
    def column(self) -> Column:
        return F.col(f"`{self.full}`")


class Scope:
    def __init__(self, fields: list[Field]):
        self.fields = fields
        self.by_full = {f.full: f for f in fields}

    def find(self, name: str) -> Field:
        if name in self.by_full:
            return self.by_full[name]
        for f in self.fields:
            if f.name == name:
                return f
        raise ColumnNotFound(name)

    def preferring(self, table: str) -> Scope:
        """The scope with one table's columns first."""
        return Scope([f for f in self.fields if f.table == table] + [f for f in self.fields if f.table != table])


class Expr:
    """Base of expressions; the methods build larger ones."""

    def compile(self, scope: Scope) -> tuple[Column, str]:
        """(column, Spark type)."""
        raise NotImplementedError

    def column(self, scope: Scope) -> Column:
        return self.compile(scope)[0]

    def eq(self, other):
        return Comparison("=", self, wrap(other))

    def ne(self, other):
        return Comparison("<>", self, wrap(other))

    def gt(self, other):
        return Comparison(">", self, wrap(other))

    def gte(self, other):
        return Comparison(">=", self, wrap(other))

    def lt(self, other):
        return Comparison("<", self, wrap(other))

    def lte(self, other):
        return Comparison("<=", self, wrap(other))

    def between(self, low, high):
        return Test("between", self, (low, high))

    def not_between(self, low, high):
        return Test("not_between", self, (low, high))

    def in_(self, values):
        return Test("in_list", self, (list(values),))

    def not_in(self, values):
        return Test("not_in_list", self, (list(values),))

    def like(self, pattern):
        return Test("like", self, (pattern,))

    def not_like(self, pattern):
        return Test("not_like", self, (pattern,))

    def match(self, pattern):
        return Test("matches", self, (pattern,))

    def not_match(self, pattern):
        return Test("not_matches", self, (pattern,))

    def is_null(self):
        return IsNull(self, True)

    def is_not_null(self):
        return IsNull(self, False)

    def get(self, path: str) -> JsonPath:
        return JsonPath(self, path)

    def and_(self, other):
        return Logic("and", self, other)

    def or_(self, other):
        return Logic("or", self, other)

    def not_(self):
        return Not(self)

    __and__, __or__ = and_, or_

    def __invert__(self):
        return self.not_()

    def __add__(self, other):
        return Arithmetic("+", self, wrap(other))

    def __sub__(self, other):
        return Arithmetic("-", self, wrap(other))

    def __mul__(self, other):
        return Arithmetic("*", self, wrap(other))

    def __truediv__(self, other):
        return Arithmetic("/", self, wrap(other))

    def __mod__(self, other):
        return Arithmetic("%", self, wrap(other))

    def __neg__(self):
        return Negation(self)


def wrap(value: Any) -> Expr:
    return value if isinstance(value, Expr) else Literal(value)


@dataclass(frozen=True, eq=False)
class Name(Expr):
    name: str

    def compile(self, scope):
        f = scope.find(self.name)
        return f.column, f.spark_type


@dataclass(frozen=True, eq=False)
class Literal(Expr):
    value: Any

    def compile(self, scope):
        v = self.value
        if isinstance(v, bool):
            return F.lit(v), "boolean"
        if isinstance(v, int):
            wide = not -(1 << 31) <= v < 1 << 31
            return F.lit(v), "bigint" if wide else "int"
        if isinstance(v, float):
            return F.lit(v), "double"
        if isinstance(v, (bytes, bytearray)):
            return F.lit(bytes(v)), "binary"
        if isinstance(v, dt.datetime):
            return F.lit(v), "timestamp"
        return F.lit(v), "void" if v is None else "string"


def _matched(value: Any, spark_type: str) -> Any:
    """A literal as fits a column: milliseconds or text for timestamps."""
    if spark_type in ("timestamp", "timestamp_ntz") and value is not None and not isinstance(value, Column):
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            value = F.timestamp_millis(F.lit(int(value)))
        return F.lit(value).cast(spark_type)
    return value


@dataclass(frozen=True, eq=False)
class Comparison(Expr):
    op: str
    left: Expr
    right: Expr

    def compile(self, scope):
        (a, ta), (b, tb) = self.left.compile(scope), self.right.compile(scope)
        if isinstance(self.right, Literal):
            b = F.lit(_matched(self.right.value, ta))
        elif isinstance(self.left, Literal):
            a = F.lit(_matched(self.left.value, tb))
        made = {"=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}
        return made[self.op](), "boolean"


@dataclass(frozen=True, eq=False)
class Test(Expr):
    """One of the two-valued predicates; the arguments are plain values."""

    __test__ = False
    name: str
    operand: Expr
    args: tuple

    def compile(self, scope):
        c, kind = self.operand.compile(scope)
        args = [[_matched(x, kind) for x in a] if isinstance(a, list) else a if self.name not in ("between", "not_between") else _matched(a, kind) for a in self.args]
        return getattr(predicates, self.name)(c, *args), "boolean"


@dataclass(frozen=True, eq=False)
class IsNull(Expr):
    operand: Expr
    wanted: bool

    def compile(self, scope):
        c = self.operand.column(scope)
        return c.isNull() if self.wanted else c.isNotNull(), "boolean"


@dataclass(frozen=True, eq=False)
class Logic(Expr):
    op: str
    left: Expr
    right: Expr

    def compile(self, scope):
        a, b = self.left.column(scope), self.right.column(scope)
        return a & b if self.op == "and" else a | b, "boolean"


@dataclass(frozen=True, eq=False)
class Not(Expr):
    operand: Expr

    def compile(self, scope):
        return ~self.operand.column(scope), "boolean"


@dataclass(frozen=True, eq=False)
class Arithmetic(Expr):
    op: str
    left: Expr
    right: Expr

    def compile(self, scope):
        (a, ta), (b, tb) = self.left.compile(scope), self.right.compile(scope)
        # An integer literal takes the width of the other side.
        if isinstance(self.right, Literal) and (ta, tb) == ("bigint", "int"):
            b, tb = b.cast("bigint"), "bigint"
        if isinstance(self.left, Literal) and (ta, tb) == ("int", "bigint"):
            a, ta = a.cast("bigint"), "bigint"
        return scalar.arithmetic(self.op, a, b, ta, tb)


@dataclass(frozen=True, eq=False)
class Negation(Expr):
    operand: Expr

    def compile(self, scope):
        c, kind = self.operand.compile(scope)
        if kind not in scalar.NUMBERS:
            return F.lit(None).cast("double"), "double"
        return scalar.negate(c, kind), kind


@dataclass(frozen=True, eq=False)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]

    def compile(self, scope):
        if self.name.upper().startswith("JSONB_"):
            test = {"JSONB_PATH_EQ": "equals", "JSONB_CONTAINS": "contains", "JSONB_EXISTS": "exists"}.get(self.name.upper())
            if test is None:
                raise ValueError(f"unknown function {self.name}")
            doc, path, *value = self.args
            return JsonTest(test, JsonPath(doc, path.value), tuple(v.value for v in value)).compile(scope)
        make, kind = scalar.function(self.name)
        columns, kinds = zip(*[a.compile(scope) for a in self.args]) if self.args else ((), ())
        return make(list(columns), list(kinds)), kind(list(kinds))


@dataclass(frozen=True)
class JsonPath:
    operand: Expr
    path: str

    def eq(self, value) -> Expr:
        return JsonTest("equals", self, (value,))

    def contains(self, value) -> Expr:
        return JsonTest("contains", self, (value,))

    def exists(self) -> Expr:
        return JsonTest("exists", self, ())


@dataclass(frozen=True, eq=False)
class JsonTest(Expr):
    name: str
    target: JsonPath
    args: tuple

    def compile(self, scope):
        c = self.target.operand.column(scope)
        return getattr(jsonpath, self.name)(c, self.target.path, *self.args), "boolean"


@dataclass(frozen=True, eq=False)
class Raw(Expr):
    """Any function from the column of one expression to a Column, for operators outside the algebra."""

    operand: Expr
    make: Any
    kind: str = "string"

    def compile(self, scope):
        return self.make(self.operand.column(scope)), self.kind


def col(name: str) -> Name:
    return Name(name)


def lit(value: Any) -> Literal:
    return Literal(value)


def call(name: str, *args: Any) -> Call:
    return Call(name, tuple(wrap(a) for a in args))


TRUE = Literal(True)

"""The fluent query builder."""

from __future__ import annotations

import re
from collections import Counter
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame

from ..errors import ColumnNotFound, EngineError
from ..functions import aggregates
from . import nodes
from .expr import Expr, Field, Name, Scope, col

if TYPE_CHECKING:
    from ..database import Database

_ALIAS = re.compile(r"\s+as\s+", re.IGNORECASE)


def split_alias(name: str) -> tuple[str, str]:
    """``table as t`` -> (table, t)."""
    parts = _ALIAS.split(name.strip(), 1)
    return parts[0], parts[-1]


class Select:
    """``db.select(...).from_(...)``; methods change the builder and return it.

    Whatever the order of calls, a query filters, then aggregates, sorts, limits and
    projects. After a union the rest applies to the union's result."""

    def __init__(self, db: Database, columns: tuple):
        self.db = db
        flat = [c for item in columns for c in (item if isinstance(item, (list, tuple)) and not _computed(item) else [item])]
        self.columns = [c for c in flat if c != "*"] if flat and "*" not in flat else []
        self.source: nodes.Node | None = None
        self.main = ""
        self.optional: set[str] = set()
        self._reset()

    def _reset(self):
        self.condition: Expr | None = None
        self.groups: list[str] = []
        self.calls: list[tuple[str, str | None]] = []
        self.orders: list[tuple[Any, bool]] = []
        self._limit: int | None = None
        self._offset = 0

    # ---- sources
    def from_(self, table: str) -> Select:
        self.source = self._scan(table)
        self.main = split_alias(table)[1]
        return self

    def _scan(self, name: str) -> nodes.Scan:
        table, alias = split_alias(name)
        return nodes.Scan(table, alias, tuple(self.db.fields(table, alias)))

    def _join(self, name: str, condition: Expr | None, kind: str) -> Select:
        if self.source is None:
            raise EngineError("from_ comes before a join")
        scan = self._scan(name)
        if any(f.table == scan.alias for f in self.source.scope.fields):
            raise EngineError(f"{scan.alias} is joined twice; give it an alias")
        self.source = nodes.Join(self.source, scan, kind, condition, scan.alias)
        if kind in ("left", "full"):
            self.optional.add(scan.alias)
        return self

    def inner_join(self, table: str, condition: Expr) -> Select:
        return self._join(table, condition, "inner")

    def left_join(self, table: str, condition: Expr) -> Select:
        return self._join(table, condition, "left")

    def right_join(self, table: str, condition: Expr) -> Select:
        return self._join(table, condition, "right")

    def full_join(self, table: str, condition: Expr) -> Select:
        return self._join(table, condition, "full")

    def cross_join(self, table: str) -> Select:
        return self._join(table, None, "cross")

    # ---- clauses
    def where(self, condition: Expr) -> Select:
        self.condition = condition if self.condition is None else self.condition & condition
        return self

    def group_by(self, *names) -> Select:
        self.groups += [n for x in names for n in (x if isinstance(x, (list, tuple)) else [x])]
        return self

    def count(self) -> Select:
        return self._call("count", None)

    def count_col(self, name: str) -> Select:
        return self._call("count", name)

    def sum(self, name: str) -> Select:
        return self._call("sum", name)

    def avg(self, name: str) -> Select:
        return self._call("avg", name)

    def min(self, name: str) -> Select:
        return self._call("min", name)

    def max(self, name: str) -> Select:
        return self._call("max", name)

    def distinct(self, name: str) -> Select:
        return self._call("distinct", name)

    def stddev(self, name: str) -> Select:
        return self._call("stddev", name)

    def geomean(self, name: str) -> Select:
        return self._call("geomean", name)

    def _call(self, func: str, name: str | None) -> Select:
        self.calls.append((func, name))
        return self

    def order_by(self, name: str | Expr, order: str = "asc") -> Select:
        self.orders.append((name, str(order).lower() != "desc"))
        return self

    def limit(self, n: int) -> Select:
        self._limit = n
        return self

    def offset(self, n: int) -> Select:
        self._offset = n
        return self

    def union(self, other: Select) -> Select:
        return self._union(other, True)

    def union_all(self, other: Select) -> Select:
        return self._union(other, False)

    def _union(self, other: Select, distinct: bool) -> Select:
        self.source = nodes.Union(self.plan(), other.plan(), distinct)
        self.main, self.columns, self.optional = "", [], set()
        self._reset()
        return self

    # ---- plan
    def plan(self) -> nodes.Node:
        if self.source is None:
            raise EngineError("a query needs from_")
        node = self.source
        if self.condition is not None:
            node = nodes.Filter(node, self.condition)
        aggregated = bool(self.groups or self.calls)
        if aggregated:
            scope = node.scope.preferring(self.main)
            keys = [scope.find(n) for n in self.groups]
            names = _names([(f, f.full) for f in keys])
            calls = [(func, scope.find(n) if n else None, aggregates.output_name(func, n)) for func, n in self.calls]
            node = nodes.Aggregate(node, tuple(zip(keys, names)), tuple(calls))
        if self.orders:
            scope = node.scope if aggregated else node.scope.preferring(self.main)
            orders = [(_resolved(e, scope, aggregated), up) for e, up in self.orders]
            node = nodes.Sort(node, tuple(orders))
        if self._limit is not None or self._offset:
            node = nodes.Limit(node, self._limit, self._offset)
        return self._projected(node, aggregated)

    def _projected(self, node: nodes.Node, aggregated: bool) -> nodes.Node:
        scope = node.scope
        if not self.columns:
            if not any(f.table for f in scope.fields):
                return node
            count = Counter(f.name for f in scope.fields)
            return nodes.Project(node, tuple((Name(f.full), f.full if count[f.name] > 1 else f.name) for f in scope.fields))
        if aggregated:
            chosen = [_resolved(c, scope, True) if isinstance(c, str) else c for c in self.columns]
            return nodes.Project(node, tuple((e, e.name) for e in chosen))
        scope = scope.preferring(self.main)
        plain = [(scope.find(c), c) if isinstance(c, str) else None for c in self.columns]
        names = iter(_names([p for p in plain if p]))
        out = []
        for p, c in zip(plain, self.columns):
            if p:
                out.append((Name(p[0].full), next(names)))
            else:
                expression, name = c if isinstance(c, tuple) else (c, getattr(c, "name", "value"))
                out.append((expression, name))
        return nodes.Project(node, tuple(out))

    # ---- results
    def frame(self) -> DataFrame:
        """The query as a DataFrame of the current state."""
        return self.plan().frame(self.db.snapshot())

    def exec(self) -> list[dict]:
        return [row.asDict(recursive=True) for row in self.frame().collect()]

    def arrow(self):
        """The result as an Arrow table, the columnar transport of results."""
        return self.frame().toArrow()

    def prepare(self) -> Prepared:
        return Prepared(self.db, self.plan())

    def explain(self) -> dict[str, str]:
        """Catalyst's plans: logical (as analysed), optimized and physical."""
        run = self.frame()._jdf.queryExecution()
        return {"logical": run.analyzed().toString(), "optimized": run.optimizedPlan().toString(), "physical": run.executedPlan().toString()}

    def schema_layout(self) -> list[dict]:
        """Names, types and nullability of the result's columns."""
        return [{"name": f.name, "type": f.dataType.simpleString(), "nullable": f.nullable} for f in self.frame().schema.fields]

    def observe(self):
        return self.db.live.snapshot_query(self.plan(), initial=False)

    def changes(self):
        return self.db.live.snapshot_query(self.plan(), initial=True)

    def trace(self):
        return self.db.live.delta_query(self.plan())


class Prepared:
    """A plan that is run again on the state at the time of each call."""

    def __init__(self, db: Database, plan: nodes.Node):
        self.db, self.plan = db, plan

    def frame(self) -> DataFrame:
        return self.plan.frame(self.db.snapshot())

    def exec(self) -> list[dict]:
        return [row.asDict(recursive=True) for row in self.frame().collect()]

    def arrow(self):
        return self.frame().toArrow()


def _computed(item) -> bool:
    return isinstance(item, tuple) and len(item) == 2 and isinstance(item[0], Expr)


def _names(chosen: list[tuple[Field, str]]) -> list[str]:
    """Output names: the simple name, or the full one where simple names collide."""
    count = Counter(f.name for f, _ in chosen)
    return [f.full if count[f.name] > 1 else f.name for f, _ in chosen]


def _resolved(e, scope: Scope, output: bool) -> Expr:
    if isinstance(e, Expr):
        return e
    try:
        return Name(scope.find(e).full)
    except ColumnNotFound:
        if output and "." in e:
            return Name(scope.find(e.rpartition(".")[2]).full)
        raise


__all__ = ["Prepared", "Select", "col", "split_alias"]

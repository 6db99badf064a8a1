"""Running GraphQL operations as DataFrames.

A root field is a filter, a sort and a limit. Relations nest without a query for each
row: a forward relation is one left join, a reverse relation one aggregation of child
rows by their foreign key, with limits applied to each parent's children by a window.
Where the rows above are not a whole table, only the rows that their keys lead to are read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import GraphQLError
from ..functions import jsonb, jsonpath
from ..operators import dml
from ..plans.expr import Expr, Raw, col
from ..schema import TableSchema, coerce
from ..sources.store import checkpointed
from ..streaming.live import SnapshotQuery
from .catalog import Catalog, Relation, type_name
from .document import Directive, Enum, Operation, Selection, Variable, parse


class Bound:
    """One operation with its variables filled in and its directives applied."""

    def __init__(self, operation: Operation, variables: dict[str, Any] | None):
        given, self.values = variables or {}, {}
        for d in operation.variables:
            if d.name in given:
                self.values[d.name] = given[d.name]
            elif d.has_default:
                self.values[d.name] = d.default
            elif d.type.endswith("!"):
                raise GraphQLError(f"variable {d.name} is missing")
            else:
                self.values[d.name] = None
            if self.values[d.name] is None and d.type.endswith("!"):
                raise GraphQLError(f"variable {d.name} must not be null")
        self.kind = operation.kind
        self.selections = self.selected(operation.selections)

    def filled(self, value: Any) -> Any:
        if isinstance(value, Variable):
            if value.name not in self.values:
                raise GraphQLError(f"unknown variable {value.name}")
            return self.values[value.name]
        if isinstance(value, list):
            return [self.filled(v) for v in value]
        if isinstance(value, dict):
            return {k: self.filled(v) for k, v in value.items()}
        return value.name if isinstance(value, Enum) else value

    def selected(self, selections: list[Selection]) -> list[Selection]:
        out: dict[str, Selection] = {}
        for s in selections:
            if not self.included(s.directives):
                continue
            made = Selection(s.name, s.alias, self.filled(s.arguments), [], self.selected(s.selections))
            known = out.get(s.key)
            if known is not None and (known.name, known.arguments) != (made.name, made.arguments):
                raise GraphQLError(f"{s.key} means two things")
            out[s.key] = made if known is None else Selection(s.name, s.alias, made.arguments, [], _merged(known.selections, made.selections))
        return list(out.values())

    def included(self, directives: list[Directive]) -> bool:
        seen, keep = set(), True
        for d in directives:
            if d.name not in ("include", "skip") or d.name in seen:
                raise GraphQLError(f"directive @{d.name} is unknown or repeated")
            seen.add(d.name)
            wanted = self.filled(d.arguments.get("if"))
            if not isinstance(wanted, bool):
                raise GraphQLError(f"@{d.name} needs a Boolean")
            keep &= wanted == (d.name == "include")
        return keep


def _merged(a: list[Selection], b: list[Selection]) -> list[Selection]:
    keys = {s.key for s in a}
    return a + [s for s in b if s.key not in keys]


# ---- arguments
def _known(arguments: dict, *names: str) -> None:
    for a in arguments:
        if a not in names:
            raise GraphQLError(f"unknown argument {a}")


def condition(schema: TableSchema, where: dict | None) -> Expr | None:
    """The filter of a where input; several entries must all hold."""
    parts: list[Expr] = []
    for name, value in (where or {}).items():
        if value is None:
            continue
        if name in ("AND", "OR"):
            inner = [c for c in (condition(schema, w) for w in (value if isinstance(value, list) else [value])) if c is not None]
            if inner:
                made = inner[0]
                for c in inner[1:]:
                    made = made & c if name == "AND" else made | c
                parts.append(made)
            continue
        column = schema.column(name)
        parts += _json_tests(name, value) if column.type == "Jsonb" else [_test(column, op, v) for op, v in value.items()]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _test(column, op: str, value: Any) -> Expr:
    c = col(column.name)
    if op == "isNull":
        return c.is_null() if value else c.is_not_null()
    if op in ("in", "notIn"):
        values = [coerce(v, column) for v in value]
        return c.in_(values) if op == "in" else c.not_in(values)
    if op == "between":
        low, high = value
        return c.between(coerce(low, column), coerce(high, column))
    if op == "like":
        return c.like(value)
    if op in ("eq", "ne", "gt", "gte", "lt", "lte"):
        return getattr(c, op)(coerce(value, column))
    raise GraphQLError(f"unknown filter {op}")


def _json_tests(name: str, value: dict) -> list[Expr]:
    path, out = value.get("path") or "$", []
    for op, v in value.items():
        if op == "path":
            continue
        if op == "isNull":
            out.append(col(name).is_null() if v else col(name).is_not_null())
        elif op == "exists":
            found = col(name).get(path).exists()
            out.append(found if v else ~found)
        elif op not in ("eq", "contains"):
            raise GraphQLError(f"unknown filter {op}")
        elif isinstance(v, (dict, list)):
            out.append(Raw(col(name), _composite(op, path, v), "boolean"))
        else:
            out.append(getattr(col(name).get(path), "eq" if op == "eq" else "contains")(v))
    return out


def _composite(op: str, path: str, value: Any) -> Callable:
    wanted = jsonpath.dump(value)

    def test(c):
        first = F.get(jsonpath.query(c, path), F.lit(0))
        inside = jsonb.contains(first, wanted)
        return F.coalesce(inside & jsonb.contained_by(first, wanted) if op == "eq" else inside, F.lit(False))

    return test


def orders(schema: TableSchema, order_by: Any) -> list:
    """Sort columns; ties follow the primary key."""
    given = order_by if isinstance(order_by, list) else [order_by] if order_by else []
    by_enum = {c.upper(): c for c in schema.names}
    out, used = [], set()
    for o in given:
        name = by_enum.get(str(o["field"]).upper())
        if name is None:
            raise GraphQLError(f"unknown order field {o['field']}")
        used.add(name)
        c = F.col(f"`{name}`")
        out.append(c.desc_nulls_last() if str(o.get("direction") or "ASC").upper() == "DESC" else c.asc_nulls_first())
    return out + [F.col(f"`{k}`").asc_nulls_first() for k in schema.primary_key if k not in used]


PAGE = ("where", "orderBy", "limit", "offset")


class Runner:
    def __init__(self, catalog: Catalog, tables: dict[str, DataFrame]):
        self.catalog, self.tables = catalog, tables

    def filtered(self, table: str, arguments: dict) -> DataFrame:
        schema = self.catalog.schemas[table]
        rows, test = self.tables[table], condition(schema, arguments.get("where"))
        return rows if test is None else rows.where(test.column(dml.scope_of(schema)))

    def page(self, table: str, arguments: dict, ordered: bool = True) -> DataFrame:
        """The rows of a page; without limit and offset they are only sorted if wanted."""
        rows = self.filtered(table, arguments)
        paged = arguments.get("limit") is not None or bool(arguments.get("offset"))
        by = orders(self.catalog.schemas[table], arguments.get("orderBy"))
        if by and (paged or ordered):
            rows = rows.orderBy(*by)
        if arguments.get("offset"):
            rows = rows.offset(arguments["offset"])
        return rows if arguments.get("limit") is None else rows.limit(arguments["limit"])

    def root(self, kind: str, table: str, s: Selection) -> DataFrame:
        """The rows of a root field as one struct column ``value``, in order."""
        schema = self.catalog.schemas[table]
        related = any(x.name in self.catalog.relations[table] for x in s.selections)
        if kind == "one":
            _known(s.arguments, "pk")
            pk = s.arguments.get("pk") or {}
            if set(pk) != set(schema.primary_key):
                raise GraphQLError(f"pk needs {', '.join(schema.primary_key)}")
            rows = self.filtered(table, {"where": {k: {"eq": v} for k, v in pk.items()}})
            return self.rendered(table, rows, s.selections, True).select("value")
        _known(s.arguments, *PAGE)
        rows, by = self.page(table, s.arguments, ordered=not related), orders(schema, s.arguments.get("orderBy"))
        if related and (s.arguments.get("limit") is not None or s.arguments.get("offset")):
            rows = checkpointed(rows)  # relations read the page again and must find the same rows
        some = any(s.arguments.get(k) is not None for k in ("where", "limit", "offset"))
        out = self.rendered(table, rows, s.selections, some)
        return out.orderBy(*by).select("value") if by and related else out.select("value")

    def rendered(self, table: str, rows: DataFrame, selections: list[Selection], some: bool = False) -> DataFrame:
        """rows with a struct column ``value`` of what is selected. ``some``: the rows are not
        the whole table, so relations are read for their keys alone."""
        if not selections:
            raise GraphQLError(f"{table} needs a selection")
        schema, parts = self.catalog.schemas[table], []
        for n, s in enumerate(selections):
            if s.name == "__typename":
                parts.append(F.lit(type_name(table)).alias(s.key))
            elif s.name in schema.names:
                if s.selections or s.arguments:
                    raise GraphQLError(f"{s.name} is a plain column")
                parts.append(F.col(f"`{s.name}`").alias(s.key))
            elif s.name in self.catalog.relations[table]:
                relation = self.catalog.relations[table][s.name]
                related = self.forward if relation.forward else self.reverse
                keys = rows.select(F.col(f"`{relation.own_column}`").alias("wanted")).distinct() if some else None
                rows = related(rows, relation, s, n, keys)
                parts.append(F.col(f"relation {n}").alias(s.key))
            else:
                raise GraphQLError(f"{table} has no field {s.name}")
        keep = [F.col(f"`{c}`") for c in schema.names]
        return rows.select(*keep, F.struct(*parts).alias("value"))

    def forward(self, rows: DataFrame, r: Relation, s: Selection, n: int, keys: DataFrame | None) -> DataFrame:
        _known(s.arguments)
        parents = self.rendered(r.table, _with_keys(self.tables[r.table], r, keys), s.selections, keys is not None)
        parents = parents.select(F.col(f"`{r.other_column}`").alias(f"parent {n}"), F.col("value").alias(f"relation {n}"))
        return rows.join(parents, F.col(f"`{r.own_column}`") == F.col(f"parent {n}"), "left")

    def reverse(self, rows: DataFrame, r: Relation, s: Selection, n: int, keys: DataFrame | None) -> DataFrame:
        _known(s.arguments, *PAGE)
        limit, offset = s.arguments.get("limit"), s.arguments.get("offset") or 0
        schema = self.catalog.schemas[r.table]
        found = _with_keys(self.filtered(r.table, s.arguments), r, keys)
        children = self.rendered(r.table, found, s.selections, keys is not None)
        child = F.col(f"`{r.other_column}`").alias(f"child {n}")
        if s.arguments.get("orderBy") or offset or limit is not None:
            by = orders(schema, s.arguments.get("orderBy")) or [F.lit(1)]
            place = F.row_number().over(Window.partitionBy(f"`{r.other_column}`").orderBy(*by))
            children = children.withColumn("place", place).where(F.col("place") > offset)
            if limit is not None:
                children = children.where(F.col("place") <= offset + limit)
            lists = children.groupBy(child).agg(F.array_sort(F.collect_list(F.struct("place", "value")), lambda a, b: a["place"] - b["place"]).alias("list"))
            lists = lists.select(f"`child {n}`", F.transform("list", lambda x: x["value"]).alias(f"relation {n}"))
        else:
            key = F.struct(*[F.col(f"`{k}`") for k in schema.primary_key] or [F.lit(1)])
            lists = children.groupBy(child).agg(F.collect_list(F.struct(key.alias("key"), "value")).alias("list"))
            in_order = F.array_sort("list", lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
            lists = lists.select(f"`child {n}`", F.transform(in_order, lambda x: x["value"]).alias(f"relation {n}"))
        joined = rows.join(lists, F.col(f"`{r.own_column}`") == F.col(f"child {n}"), "left")
        empty = F.array().cast(lists.schema[f"relation {n}"].dataType)
        return joined.withColumn(f"relation {n}", F.coalesce(f"relation {n}", empty))


def _with_keys(rows: DataFrame, r: Relation, keys: DataFrame | None) -> DataFrame:
    """The rows of a relation's other side that one of the keys leads to."""
    return rows if keys is None else rows.join(keys, F.col(f"`{r.other_column}`") == F.col("wanted"), "left_semi")


class PreparedDocument:
    """A parsed document; variables are bound and rows read at each call."""

    def __init__(self, db, document: str):
        self.db, self.operations = db, parse(document)

    def _bound(self, variables, operation: str | None) -> Bound:
        named = [o for o in self.operations if operation is None or o.name == operation]
        if len(named) != 1:
            raise GraphQLError(f"no operation {operation}" if operation else "name one of the document's operations")
        return Bound(named[0], variables)

    def frame(self, variables: dict | None = None, operation: str | None = None) -> DataFrame:
        """The one root field of a query as a DataFrame of the selected columns."""
        bound = self._bound(variables, operation)
        if bound.kind != "query" or len(bound.selections) != 1:
            raise GraphQLError("frame() takes a query of one root field")
        s = bound.selections[0]
        catalog = Catalog(self.db.schemas())
        return Runner(catalog, self.db.snapshot()).root(*catalog.root("query", s.name), s).select("value.*")

    def exec(self, variables: dict | None = None, operation: str | None = None) -> dict:
        bound = self._bound(variables, operation)
        if bound.kind == "subscription":
            raise GraphQLError("use subscribe for subscriptions")
        return {"data": run(self.db, bound)}

    def subscribe(self, variables: dict | None = None, operation: str | None = None) -> Subscription:
        bound = self._bound(variables, operation)
        if bound.kind != "subscription" or len(bound.selections) != 1:
            raise GraphQLError("a subscription has one root field")
        return Subscription(self.db, bound)


def run(db, bound: Bound) -> dict:
    """The response's data. The fields of a mutation are one transaction: all or none."""
    catalog, out = Catalog(db.schemas()), {}
    tx = db.transaction() if bound.kind == "mutation" else None
    for s in bound.selections:
        if s.name == "__typename":
            out[s.key] = bound.kind.capitalize()
            continue
        kind, table = catalog.root(bound.kind, s.name)
        if tx is not None:
            out[s.key] = _mutate(tx, catalog, kind, table, s)
            continue
        rows = [r.value.asDict(recursive=True) for r in Runner(catalog, db.snapshot()).root(kind, table, s).collect()]
        out[s.key] = (rows[0] if rows else None) if kind == "one" else rows
    if tx is not None:
        tx.commit()
    return out


def _mutate(db, catalog: Catalog, verb: str, table: str, s: Selection) -> list[dict]:
    """Apply a mutation to a transaction; returns the rows it wrote, or the rows it deleted."""
    schema, current = db.schema(table), db.table(table)
    before = db.snapshot()
    if verb == "insert":
        _known(s.arguments, "input")
        given = s.arguments.get("input") or []
        change = dml.insert(db.spark, schema, current, given if isinstance(given, list) else [given])
    else:
        _known(s.arguments, *PAGE, *(["set"] if verb == "update" else []))
        paged = s.arguments.get("limit") is not None or s.arguments.get("offset")
        target = Runner(catalog, before).page(table, s.arguments) if paged else None
        test = condition(schema, s.arguments.get("where"))
        if verb == "update":
            change = dml.update(schema, current, s.arguments.get("set") or {}, test, target)
        else:
            change = dml.delete(schema, current, test, target)
    db.apply(table, change)
    rows = change.removed if verb == "delete" else change.added
    tables = before if verb == "delete" else db.snapshot()
    by = orders(schema, s.arguments.get("orderBy"))
    shown = Runner(catalog, tables).rendered(table, rows, s.selections, True)
    return [r.value.asDict(recursive=True) for r in (shown.orderBy(*by) if by else shown).collect()]


class Subscription:
    """A live root field; tells the whole response when it differs.

    A collection without relations, order and page is patched from the delta of a change;
    any other is evaluated again. Without subscribers it catches up when it is read."""

    def __init__(self, db, bound: Bound):
        self.db, self.bound = db, bound
        self.callbacks: list[Callable] = []
        self.stale = self.current = False
        catalog, (s,) = Catalog(db.schemas()), bound.selections
        kind, table = catalog.root("subscription", s.name)
        self.tables = _tables(catalog, table, s)
        self.plan = self  # the registry asks a query's plan for its tables
        self.rows = None
        if kind != "one" and len(self.tables) == 1 and not any(s.arguments.get(k) is not None for k in ("orderBy", "limit", "offset")):
            self.rows = self._live_rows(catalog.schemas[table], s)
        self.result = self._now()
        db.live.queries.append(self)

    def _live_rows(self, schema: TableSchema, s: Selection) -> SnapshotQuery:
        query, test = self.db.select("*").from_(schema.name), condition(schema, s.arguments.get("where"))
        return SnapshotQuery(self.db.live, (query if test is None else query.where(test)).plan(), False)

    def _now(self) -> dict:
        if self.rows is None:
            return {"data": run(self.db, self.bound)}
        (s,) = self.bound.selections
        table = next(iter(self.tables))
        names = {x.key: x.name for x in s.selections}
        keys = self.db.schema(table).primary_key
        rows = sorted(self.rows.rows, key=lambda r: [(r[k] is not None, r[k]) for k in keys])
        return {"data": {s.key: [{k: type_name(table) if n == "__typename" else r[n] for k, n in names.items()} for r in rows]}}

    def changed(self, before, after, deltas) -> None:
        if self.rows is not None and not self.rows._patched(before, after, deltas):
            return
        now = self._now()
        if now != self.result:
            self.result = now
            for callback in list(self.callbacks):
                callback(now)

    def _fresh(self) -> None:
        if self.stale:
            self.stale = False
            if self.rows is not None:
                self.rows._start(self.db.snapshot())
            self.result = self._now()

    def get_result(self) -> dict:
        self._fresh()
        return self.result

    def subscribe(self, callback: Callable) -> Callable[[], None]:
        self._fresh()
        self.callbacks.append(callback)
        return lambda: self.callbacks.remove(callback) if callback in self.callbacks else None

    def subscription_count(self) -> int:
        return len(self.callbacks)

    def close(self) -> None:
        self.callbacks.clear()
        if self in self.db.live.queries:
            self.db.live.queries.remove(self)


def _tables(catalog: Catalog, table: str, s: Selection) -> set[str]:
    out = {table}
    for inner in s.selections:
        if inner.name in catalog.relations[table]:
            out |= _tables(catalog, catalog.relations[table][inner.name].table, inner)
    return out

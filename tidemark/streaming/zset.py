"""Z-sets: rows with an integer multiplicity ``_d``, and delta rules for plans.

``delta(plan, before, after, deltas)`` is the change of a plan's result for a change of
its tables: what it adds has positive, what it loses negative multiplicity. Linear
operators work on the delta alone; joins meet it with the other side; outer joins and
aggregates look again at the keys and groups it touches, before and after. Sides and
groups are found by joins with the delta's keys, which are broadcast while they are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotIncremental
from ..functions.scalar import BOUNDS
from ..plans import nodes

D = "_d"


def _columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != D]


def _cols(names: list[str]):
    return [F.col(f"`{c}`") for c in names]


def weighted(df: DataFrame, weight: int = 1) -> DataFrame:
    return df.withColumn(D, F.lit(weight).cast("long"))


def consolidate(z: DataFrame) -> DataFrame:
    """One row for each distinct row whose multiplicities do not cancel (NULLs are equal)."""
    return z.groupBy(*_cols(_columns(z))).agg(F.sum(D).alias(D)).where(F.col(D) != 0)


def rows(z: DataFrame) -> DataFrame:
    """The multiset as plain rows; multiplicities are not negative."""
    repeated = z.withColumn(D, F.explode(F.sequence(F.lit(1).cast("long"), F.col(D))))
    return repeated.drop(D)


def difference(after: DataFrame, before: DataFrame) -> DataFrame:
    return consolidate(weighted(after).union(weighted(before, -1)))


def is_incremental(plan: nodes.Node) -> bool:
    return not isinstance(plan, (nodes.Sort, nodes.Limit)) and all(is_incremental(n) for n in plan.inputs)


def _semi(df: DataFrame, keys: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows of df whose key columns are among the keys; NULL equals NULL."""
    keys = keys.select(*[F.col(f"`{k}`").alias(f"key {i}") for i, (_, k) in enumerate(pairs)]).distinct()
    on = [F.col(f"`{c}`").eqNullSafe(F.col(f"`key {i}`")) for i, (c, _) in enumerate(pairs)]
    condition = on[0]
    for c in on[1:]:
        condition = condition & c
    return df.join(keys, condition, "left_semi")


def delta(plan: nodes.Node, before: nodes.Tables, after: nodes.Tables, deltas: dict[str, DataFrame]) -> DataFrame | None:
    """The change of the plan's rows as a Z-set; None where none of its tables changed."""
    if not plan.tables & set(deltas):
        return None
    if isinstance(plan, nodes.Scan):
        return plan.renamed(deltas[plan.table], D)
    if isinstance(plan, nodes.Filter):
        return plan.build(delta(plan.input, before, after, deltas))
    if isinstance(plan, nodes.Project):
        return plan.build(delta(plan.input, before, after, deltas), D)
    if isinstance(plan, nodes.Join):
        return _join(plan, before, after, deltas)
    if isinstance(plan, nodes.Aggregate):
        return _aggregate(plan, before, after, deltas)
    if isinstance(plan, nodes.Union):
        return _union(plan, before, after, deltas)
    raise NotIncremental(type(plan).__name__)


def _join(plan: nodes.Join, before, after, deltas) -> DataFrame:
    left, right = (delta(n, before, after, deltas) for n in plan.inputs)
    if plan.kind in ("inner", "cross"):
        parts = []
        names = [f.full for f in plan.scope.fields]
        if left is not None:  # what the left change meets in the old right side
            parts.append(plan.build(left, plan.right.frame(before)).select(*_cols(names), D))
        if right is not None:  # what the right change meets in the new left side
            parts.append(plan.build(plan.left.frame(after), right).select(*_cols(names), D))
        return parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    key = plan.equal_names()
    if key is None:
        return _theta_join(plan, left, right, before, after)
    touched = [z.select(F.col(f"`{k}`").alias("k")) for z, k in ((left, key[0]), (right, key[1])) if z is not None]
    keys = touched[0] if len(touched) == 1 else touched[0].union(touched[1])

    def side(tables):
        parts = [_semi(n.frame(tables), keys, [(k, "k")]) for n, k in zip(plan.inputs, key)]
        return plan.build(*parts)

    return difference(side(after), side(before))


def _theta_join(plan: nodes.Join, left, right, before, after) -> DataFrame:
    """An outer join without an equality: what each row of an outer side joins depends on
    that row and the other side alone, so only rows that changed, or that the other side's
    changed rows meet, are joined again."""
    condition = plan.on()

    def touched(node, own, other):
        """Distinct rows of a side to look at again."""
        names = [f.full for f in node.scope.fields]
        found = [own.select(*_cols(names))] if own is not None else []
        if other is not None:
            changed = other.drop(D)
            found += [node.frame(tables).join(changed, condition, "left_semi") for tables in (before, after)]
        return names, (found[0] if len(found) == 1 else found[0].unionByName(found[1]) if len(found) == 2 else found[0].unionByName(found[1]).unionByName(found[2])).distinct()

    names = [f.full for f in plan.scope.fields]
    parts = []
    if plan.kind in ("left", "full"):
        own, rows_ = touched(plan.left, left, right)
        pairs = [(n, n) for n in own]
        parts += [weighted(_semi(plan.left.frame(t), rows_, pairs).join(plan.right.frame(t), condition, "left").select(*_cols(names)), w) for t, w in ((after, 1), (before, -1))]
    if plan.kind in ("right", "full"):
        own, rows_ = touched(plan.right, right, left)
        pairs = [(n, n) for n in own]
        for t, w in ((after, 1), (before, -1)):
            side = _semi(plan.right.frame(t), rows_, pairs)
            if plan.kind == "right":
                joined = plan.left.frame(t).join(side, condition, "right")
            else:  # the pairs are there already; what is left are rows that meet none
                joined = side.join(plan.left.frame(t), condition, "left_anti").select(*[F.lit(None).cast(f.spark_type).alias(f.full) if f.full in plan.left.scope.by_full else F.col(f"`{f.full}`") for f in plan.scope.fields])
            parts.append(weighted(joined.select(*_cols(names)), w))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return consolidate(out)


def _aggregate(plan: nodes.Aggregate, before, after, deltas) -> DataFrame:
    if not plan.keys:
        return difference(plan.frame(after), plan.frame(before))
    change = delta(plan.input, before, after, deltas)
    pairs = [(f.full, f.full) for f, _ in plan.keys]

    def groups(tables):
        return plan.build(_semi(plan.input.frame(tables), change, pairs))

    return difference(groups(after), groups(before))


def _union(plan: nodes.Union, before, after, deltas) -> DataFrame:
    parts = [delta(n, before, after, deltas) for n in plan.inputs]
    names = [f.full for f in plan.left.scope.fields]
    parts = [p.toDF(*names, D) for p in parts if p is not None]
    change = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    if not plan.distinct:
        return change
    pairs = [(n, n) for n in names]

    def present(tables):
        both = plan.left.frame(tables).union(plan.right.frame(tables))
        return _semi(both, change, pairs).distinct()

    return difference(present(after), present(before))


class LinearAggregate:
    """COUNT, SUM and AVG, by group or of all rows, kept from deltas alone: the cost of a
    change does not depend on the table. State: the keys, ``n`` rows, and for each argument
    its non-NULL count and sum; sums of whole numbers are kept as decimals, so they neither
    overflow nor drift."""

    FUNCTIONS = ("count", "sum", "avg")

    @classmethod
    def is_exact(cls, plan: nodes.Aggregate) -> bool:
        """Whether the kept sums are exact: whole numbers only, as sums of doubles drift."""
        whole = all(func == "count" or f.spark_type in ("int", "bigint") for func, f, _ in plan.calls)
        return bool(plan.calls) and whole and all(func in cls.FUNCTIONS for func, _, _ in plan.calls)

    def __init__(self, plan: nodes.Aggregate, tables: nodes.Tables):
        if any(func not in self.FUNCTIONS for func, _, _ in plan.calls):
            raise NotIncremental("only COUNT, SUM and AVG are linear")
        self.plan = plan
        self.arguments = list(dict.fromkeys(f for _, f, _ in plan.calls if f is not None))
        self.state = self._sums(weighted(plan.input.frame(tables)))

    def _sums(self, z: DataFrame) -> DataFrame:
        d, made = F.col(D), [F.coalesce(F.sum(D), F.lit(0)).alias("n")]
        for i, f in enumerate(self.arguments):
            made.append(F.coalesce(F.sum(F.when(f.column.isNotNull(), d)), F.lit(0)).alias(f"n{i}"))
            if f.spark_type in ("double", "float"):
                made.append(F.coalesce(F.sum(f.column * d), F.lit(0.0)).alias(f"s{i}"))
            else:
                whole = f.column if f.spark_type in ("int", "bigint") else F.lit(0)
                made.append(F.coalesce(F.sum(whole.cast("decimal(19,0)") * d.cast("decimal(19,0)")), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}"))
        return z.groupBy(*[f.column.alias(name) for f, name in self.plan.keys]).agg(*made)

    def _merged(self, sums: DataFrame) -> DataFrame:
        keys = [name for _, name in self.plan.keys]
        added = [F.sum(c).cast(sums.schema[c].dataType).alias(c) for c in sums.columns if c not in keys]
        out = sums.groupBy(*_cols(keys)).agg(*added)
        return out.where("n <> 0") if keys else out

    def apply(self, change: DataFrame) -> DataFrame:
        """Take in a Z-set of the input; returns what it changes in the result, from the
        touched groups of the state alone."""
        sums = self._sums(change)
        old = self.state
        if self.plan.keys:
            old = _semi(self.state, sums, [(name, name) for _, name in self.plan.keys])
        new = self._merged(old.unionByName(sums))
        self.state = self._merged(self.state.unionByName(sums))
        return difference(self._result(new), self._result(old))

    def frame(self) -> DataFrame:
        return self._result(self.state)

    def _result(self, state: DataFrame) -> DataFrame:
        out = _cols([name for _, name in self.plan.keys])
        for func, f, name in self.plan.calls:
            i = self.arguments.index(f) if f is not None else None
            if func == "count":
                out.append(F.col("n" if i is None else f"n{i}").alias(name))
            elif func == "sum":
                kind = state.schema[f"s{i}"].dataType.simpleString()
                low, high = (F.lit(b).cast("decimal(38,0)") for b in BOUNDS["bigint"])
                out.append((F.col(f"s{i}") if kind == "double" else F.least(F.greatest(F.col(f"s{i}"), low), high).cast("bigint")).alias(name))
            else:
                out.append(F.try_divide(F.col(f"s{i}").cast("double"), F.col(f"n{i}").cast("double")).alias(name))
        return state.select(*out)

"""Live queries: results that follow changes of their tables.

A snapshot query reports the whole result when it differs; a delta query keeps a
materialized Z-set and reports what was added and removed. Both are told once for each
mutation or committed transaction. A query nobody has subscribed to is only marked: it
catches up when it is read or subscribed to.

What a change costs: a delta query works on the delta and on what it touches, and logs
the outcome; the log is merged into the view every MERGE_EVERY changes. A snapshot query
of filters and projections alone patches its rows from the delta; any other runs again,
and Spark compares the count and a hash of the result before any row comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotIncremental
from ..plans import nodes
from ..sources.store import checkpointed
from . import zset

if TYPE_CHECKING:
    from ..database import Database

#: Changes of a view that are logged before they are merged into it.
MERGE_EVERY = 16


def _dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


class LiveQuery:
    def __init__(self, registry: LiveRegistry, plan: nodes.Node):
        self.registry, self.plan = registry, plan
        self.callbacks: list[Callable] = []
        self.stale = self.current = False

    def keep_current(self) -> LiveQuery:
        """Follow every change, subscribers or not."""
        self._fresh()
        self.current = True
        return self

    def subscribe(self, callback: Callable) -> Callable[[], None]:
        """Calls back on changes; returns the function that ends it."""
        self._fresh()
        self.callbacks.append(callback)

        def unsubscribe():
            if callback in self.callbacks:
                self.callbacks.remove(callback)

        return unsubscribe

    def subscription_count(self) -> int:
        return len(self.callbacks)

    def close(self) -> None:
        self.callbacks.clear()
        if self in self.registry.queries:
            self.registry.queries.remove(self)

    def _fresh(self) -> None:
        """Catch up with changes that came while nobody listened."""
        if self.stale:
            self.stale = False
            self._start(self.registry.db.snapshot())

    def _start(self, tables) -> None:
        """Evaluate from the tables as they are."""
        raise NotImplementedError

    def _tell(self, value) -> None:
        for callback in list(self.callbacks):
            callback(value)


def is_row_local(plan: nodes.Node) -> bool:
    """Whether each row of the result follows from one row of one table."""
    return isinstance(plan, nodes.Scan) or isinstance(plan, (nodes.Filter, nodes.Project)) and is_row_local(plan.input)


def keeps_rows(plan: nodes.Node) -> bool:
    """Whether a plan gives rows of one table as they are; its delta is consolidated like the table's."""
    return isinstance(plan, nodes.Scan) or isinstance(plan, nodes.Filter) and keeps_rows(plan.input)


def reads_once(plan: nodes.Node) -> bool:
    """Whether the delta rule of a plan looks at each delta once."""
    if isinstance(plan, nodes.Join):
        return plan.kind in ("inner", "cross") and not plan.left.tables & plan.right.tables and all(map(reads_once, plan.inputs))
    return isinstance(plan, nodes.Scan) or isinstance(plan, (nodes.Filter, nodes.Project)) and reads_once(plan.input)


def _summary(frame: DataFrame) -> tuple:
    """Count and hash of a result; sorted results with the same rows have the same order but for ties."""
    return tuple(frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in frame.columns]).cast("decimal(38,0)"))).first())


class SnapshotQuery(LiveQuery):
    def __init__(self, registry, plan, initial: bool):
        super().__init__(registry, plan)
        self.initial, self.local = initial, is_row_local(plan)
        self._start(registry.db.snapshot())

    def _start(self, tables) -> None:
        frame = self.plan.frame(tables)
        self.mark = None if self.local else _summary(frame)
        self._hold(_dicts(frame))

    def _hold(self, rows: list[dict]) -> None:
        self.rows = rows
        if self.local:  # equal rows together, so that a patch finds them
            self.bag: dict[str, list[dict]] = {}
            for r in rows:
                self.bag.setdefault(repr(r), []).append(r)

    def subscribe(self, callback):
        end = super().subscribe(callback)
        if self.initial:
            callback(self.rows)
        return end

    def _patched(self, before, after, deltas) -> bool:
        change = zset.delta(self.plan, before, after, deltas)
        moved = _dicts(zset.consolidate(change)) if change is not None else []
        for r in sorted(moved, key=lambda r: r[zset.D]):
            n = r.pop(zset.D)
            own = self.bag.setdefault(repr(r), [])
            if n < 0:
                del own[n:]
            else:
                own += [r] * n
            if not own:
                del self.bag[repr(r)]
        if moved:
            self.rows = [r for own in self.bag.values() for r in own]
        return bool(moved)

    def changed(self, before, after, deltas) -> None:
        if self.local:
            told = self._patched(before, after, deltas)
        else:
            frame = self.plan.frame(after)
            mark = _summary(frame)
            told = mark != self.mark
            if told:
                self.mark = mark
                self._hold(_dicts(frame))
        if told:
            self._tell(self.rows)

    def get_result(self) -> list[dict]:
        self._fresh()
        return self.rows

    def __len__(self) -> int:
        self._fresh()
        return len(self.rows)


class DeltaQuery(LiveQuery):
    """The view is a Z-set, the rows of one time and a log of changes since, that only its
    own changes update; it starts from the tables as they are, so rows from before the
    subscription join and count like later ones."""

    def __init__(self, registry, plan):
        if not zset.is_incremental(plan):
            raise NotIncremental("sort and limit have no delta rule; use changes()")
        super().__init__(registry, plan)
        self._start(registry.db.snapshot())

    def _start(self, tables) -> None:
        self.log: list[DataFrame] = []
        # Counts and whole-number sums follow from deltas alone, without the tables.
        self.linear = None
        if isinstance(self.plan, nodes.Aggregate) and zset.LinearAggregate.is_exact(self.plan):
            self.linear = zset.LinearAggregate(self.plan, tables)
            self.linear.state = checkpointed(self.linear.state)
            return
        self.view = checkpointed(zset.weighted(self.plan.frame(tables)))

    def _change(self, before, after, deltas):
        if self.linear is None:
            return zset.delta(self.plan, before, after, deltas)
        change = zset.delta(self.plan.input, before, after, deltas)
        if change is None:
            return None
        made = self.linear.apply(checkpointed(change))
        made = checkpointed(made) if self.callbacks else made
        self.linear.state = checkpointed(self.linear.state)
        return made

    def changed(self, before, after, deltas) -> None:
        change = self._change(before, after, deltas)
        if change is None:
            return
        if self.linear is None:
            change = checkpointed(change if keeps_rows(self.plan) else zset.consolidate(change))
            self.log.append(change)
            if len(self.log) >= MERGE_EVERY:
                self.view, self.log = checkpointed(zset.consolidate(self._parts())), []
        if not self.callbacks:
            return
        added = _dicts(zset.rows(change.where("_d > 0")))
        removed = _dicts(zset.rows(change.where("_d < 0").withColumn("_d", -F.col("_d"))))
        if added or removed:
            self._tell({"added": added, "removed": removed})

    def _parts(self) -> DataFrame:
        out = self.view
        for change in self.log:
            out = out.union(change)
        return out

    def frame(self) -> DataFrame:
        self._fresh()
        if self.linear is not None:
            return self.linear.frame()
        return zset.rows(zset.consolidate(self._parts()) if self.log else self.view)

    def get_result(self) -> list[dict]:
        return _dicts(self.frame())

    def __len__(self) -> int:
        if self.linear is not None or self.stale:
            return self.frame().count()
        return self._parts().agg(F.coalesce(F.sum("_d"), F.lit(0))).first()[0]


class LiveRegistry:
    def __init__(self, db: Database):
        self.db = db
        self.queries: list[LiveQuery] = []

    def snapshot_query(self, plan: nodes.Node, initial: bool) -> SnapshotQuery:
        self.queries.append(query := SnapshotQuery(self, plan, initial))
        return query

    def delta_query(self, plan: nodes.Node) -> DeltaQuery:
        self.queries.append(query := DeltaQuery(self, plan))
        return query

    def query_count(self) -> int:
        return len(self.queries)

    def publish(self, before, after, changes) -> None:
        """Tell the queries of the changed tables; deltas go before snapshots."""
        touched = [q for q in self.queries if q.plan.tables & set(changes)]
        wanted = [q for q in touched if (q.callbacks or q.current) and not q.stale]
        for q in touched:
            q.stale = q.stale or q not in wanted
        if not wanted:
            return
        deltas = {}
        for table, made in changes.items():
            parts = [z for c in made for z in (zset.weighted(c.added), zset.weighted(c.removed, -1))]
            z = parts[0]
            for p in parts[1:]:
                z = z.unionByName(p)
            z = zset.consolidate(z)
            deltas[table] = z if len(wanted) == 1 and reads_once(wanted[0].plan) else checkpointed(z)
        for query in sorted(wanted, key=lambda q: isinstance(q, SnapshotQuery)):
            query.changed(before, after, deltas)

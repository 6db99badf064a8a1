"""Near copies: SimHash candidates, confirmed by the shingles the texts share.

Texts link if they share at least SHARE of their distinct shingles: common shingles by
shingles of either. A group is what links connect.

Candidates come from a family of fingerprints of the distinct shingles. Two texts meet
where one fingerprint agrees on two of its ``distance + 2`` segments (the upper nodes of
``simhash``), and are candidates if at most a quarter of all bits of the family differ.
Below an upper node they are found by the Gray-order hierarchy of ``simhash``, over all
words of the family: differences in shared bits add up from the top, and pairs of nodes
above the limit, or inside one component already, are left out.
Unrelated texts differ in half of them. A pair without a common neighbour is missed if
no fingerprint of the family agrees on two segments.

Links are looked for between all members of a group of candidates, candidates
themselves or not, by their sets of 64-bit shingle hashes. A group of over TASK_SHINGLES
shingles is cut into parts, with some members in every part to tie the parts together;
then what is not yet in the group's largest cluster is compared with everything. So no
pair of texts goes unseen unless both are known to be in one cluster.

Edge cases: null, empty and blank texts are one group; a text with fewer words than a
shingle is one shingle; repeated rows share a group; rows without an id link nothing by
themselves; an empty table gives an empty result. Texts with the same shingles are one
vertex, named by a 64-bit hash of the sorted shingle hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, require, shuffle_width
from .components import components, local_forest, spanning
from .simhash import BLOCK, LEAF, GrayIndex, _long, family_of, first_rows, gray_order, linked, masks_of, rank_of, shingle_hashes, union_of

#: Texts link at 4 / 5 of their shingles in common.
SHARE = (4, 5)
#: Shingles of a group that one task holds at once, and members, about.
TASK_SHINGLES, TASK_MEMBERS = 1 << 17, 192
#: Members of a large group, about, that all its parts hold.
TIES = 16
#: Pairs of leaves compared at once, times the words of a fingerprint.
PAIRS = 1 << 13


def shingle_sets(column: pa.Array, shingle: int, seed: int):
    """(rows, head, h) of ``shingle_hashes`` with each row's hashes sorted and without repeats."""
    for rows, head, h in shingle_hashes(column, shingle, seed):
        owner = np.repeat(np.arange(len(rows)), np.diff(head))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))
        h, owner = h[new], owner[new]
        yield rows, np.searchsorted(owner, np.arange(len(rows) + 1)), h


def name_of(h: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(h.tobytes()) or 1


def fingerprinted(docs: DataFrame, shingle: int, seed: int, family: int) -> DataFrame:
    """doc_id, node (name of the shingle set, 0 without words), n (its size) and fp0, fp1 ..."""
    names = [f"fp{k}" for k in range(family)]

    def run(batches):
        for batch in batches:
            node, n = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64)
            fps = np.zeros((family, batch.num_rows), np.uint64)
            for rows, head, h in shingle_sets(batch.column(1), shingle, seed):
                node[rows] = [name_of(h[a:b]) for a, b in zip(head[:-1], head[1:])]
                n[rows] = np.diff(head)
                fps[:, rows] = family_of(h, head, family)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node.view(np.int64)), pa.array(n), *map(pa.array, fps.view(np.int64))], ["doc_id", "node", "n", *names])

    schema = docs.select("doc_id").schema.add("node", "long").add("n", "long")
    for name in names:
        schema = schema.add(name, "long")
    return docs.mapInArrow(run, schema)


def close_forest(fps: np.ndarray, groups: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the rows of ``fps`` (texts by family) in each group, in
    order of groups, that differ in at most ``limit`` bits."""
    n = len(fps)
    cut = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    sizes = np.diff(np.append(cut, n))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= LEAF), sizes))
    f, g = fps[small], groups[small]
    for k in range(1, LEAF):
        pair = np.flatnonzero(g[k:] == g[:-k])
        if not len(pair):
            break
        near = pair[np.bitwise_count(f[pair + k] ^ f[pair]).sum(axis=1) <= limit]
        a.append(small[near])
        b.append(small[near + k])
    for i in np.flatnonzero(sizes > LEAF):
        x, y = close_pairs(fps[cut[i] : cut[i] + sizes[i]], limit)
        a.append(cut[i] + x)
        b.append(cut[i] + y)
    root = spanning(n, np.concatenate(a), np.concatenate(b))
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def close_pairs(fps: np.ndarray, limit: int, cut: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect all rows that differ in at most ``limit`` bits, found by the Gray-order
    hierarchy; with a ``cut``, all that the pairs of a row before it with one from it on connect.

    Neighbours in the order are compared first, so that what they connect is not searched again."""
    sides = [part[gray_order(fps[part])] for part in (np.arange(cut), np.arange(cut, len(fps))) if len(part)]
    order = np.concatenate(sides)
    a, b = [], []
    for side in sides:
        f, at = fps[side], int(side.min())
        for k in range(1, min(LEAF, len(f))):
            near = np.flatnonzero(np.bitwise_count(f[k:] ^ f[:-k]).sum(axis=1) <= limit)
            a.append(at + near)
            b.append(at + near + k)
    none = np.zeros(0, np.int64)
    a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
    root = spanning(len(fps), a, b)
    left, right = (GrayIndex(fps[side]) for side in (sides[0], sides[-1]))
    x, y = linked(left, right, limit, len(sides) == 1, PAIRS // fps.shape[1], root)
    return order[np.concatenate([a, x])], order[np.concatenate([b, y + (cut if len(sides) == 2 else 0)])]


def set_forest(head: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the sets flat[head[i]:head[i + 1]] that link; none is empty."""
    up, down = SHARE
    n, size = len(head) - 1, np.diff(head)
    terms, at = np.unique(flat, return_inverse=True)
    mine = np.zeros(len(terms), bool)
    a, b, todo = [], [], []
    rest, codes = np.arange(n), at
    while len(rest):
        if not todo:
            todo, codes, rest = [int(rest[0])], codes[size[rest[0]] :], rest[1:]
            continue
        i = todo.pop()
        mine[at[head[i] : head[i + 1]]] = True
        own = size[rest]
        common = np.add.reduceat(mine[codes], np.cumsum(own) - own, dtype=np.int64)
        mine[at[head[i] : head[i + 1]]] = False
        near = down * common >= up * (own + size[i] - common)
        if near.any():
            found = rest[near]
            a += [i] * len(found)
            b += found.tolist()
            todo += found.tolist()
            codes, rest = codes[np.repeat(~near, own)], rest[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


def candidates(distinct: DataFrame, distance: int, family: int, k: int) -> DataFrame:
    """Edges (a, b) between nodes that connect all candidates that meet by fingerprint k."""
    width = max(2, shuffle_width(distinct.sparkSession))
    limit = 64 * family // 4
    names = [f"fp{(k + i) % family}" for i in range(family)]  # the one they meet by leads the Gray order
    masks = F.array(*[F.lit(_long(m)) for m in masks_of(distance)])
    rows = distinct.select("node", *names, F.posexplode(masks).alias("mask", "bits"))
    rows = rows.select("mask", F.col(f"fp{k}").bitwiseAND(F.col("bits")).alias("pattern"), "node", *names)
    rows = rows.repartition(width, "mask", "pattern").sortWithinPartitions("mask", "pattern", rank_of(f"fp{k}"))
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["mask", "pattern", "block", "a", "b", "members"])

    def edges(nodes, groups):
        x, y = close_forest(nodes[:, 1:].view(np.uint64), groups, limit)
        return ((None, None, None, int(p), int(q), None) for p, q in zip(nodes[x, 0], nodes[y, 0]))

    def run(batches):
        held, first = None, 0  # rows of the last upper node, still open, and blocks of it that have gone before
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            new = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))
            group, out = np.cumsum(new), []
            start = np.flatnonzero(new)
            if len(start) > 1 and first:
                out.append((int(rows[0, 0]), int(rows[0, 1]), first, None, None, np.ascontiguousarray(rows[: start[1], 2:]).tobytes()))
                rows, group, first = rows[start[1] :], group[start[1] :], 0
            last = int(np.searchsorted(group, group[-1]))
            out += edges(np.ascontiguousarray(rows[:last, 2:]), group[:last]) if last else ()
            rows = rows[last:]
            while len(rows) > BLOCK:
                out.append((int(rows[0, 0]), int(rows[0, 1]), first, None, None, np.ascontiguousarray(rows[:BLOCK, 2:]).tobytes()))
                rows, first = rows[BLOCK:], first + 1
            held = rows
            if out:
                yield batch_of(out)
        if held is not None:
            nodes = np.ascontiguousarray(held[:, 2:])
            out = [(int(held[0, 0]), int(held[0, 1]), first, None, None, nodes.tobytes())] if first else list(edges(nodes, np.zeros(len(nodes))))
            if out:
                yield batch_of(out)

    found = checkpointed(rows.mapInArrow(run, "mask int, pattern long, block int, a long, b long, members binary"))
    edge = found.where("members IS NULL").select("a", "b")
    heavy = found.where("members IS NOT NULL").select("mask", "pattern", "block", "members")
    if heavy.limit(1).count():
        edge = edge.union(block_candidates(heavy, family, limit, width))
    return local_forest(edge)


def block_candidates(blocks: DataFrame, family: int, limit: int, width: int) -> DataFrame:
    """Edges from all pairs of blocks of the same upper node; the pairs are dealt out evenly."""
    count = blocks.groupBy("mask", "pattern").agg((F.max("block") + 1).alias("n"))
    pairs = blocks.join(count, ["mask", "pattern"])
    pairs = pairs.select("mask", "pattern", "block", "members", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    pairs = pairs.groupBy("mask", "pattern", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list("members").alias("sides"))

    def run(batches):
        for batch in batches:
            for sides in batch.column(0).to_pylist():
                sides = [np.frombuffer(s, np.int64).reshape(-1, family + 1) for s in sides]
                nodes = np.concatenate(sides)
                x, y = close_pairs(np.ascontiguousarray(nodes[:, 1:]).view(np.uint64), limit, len(sides[0]) if len(sides) == 2 else 0)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[x, 0]), pa.array(nodes[y, 0])], ["a", "b"])

    return checkpointed(pairs.select("sides").repartition(width).mapInArrow(run, "a long, b long"))


def confirmed(sets: DataFrame, *keys: str) -> DataFrame:
    """Edges (a, b) that connect the nodes of ``sets`` (node, shingles) that link and share the keys."""
    width = max(2, shuffle_width(sets.sparkSession))
    rows = sets.repartition(width, *keys).sortWithinPartitions(*keys).select(F.struct(*keys).alias("part"), "node", "shingles")

    def linked(node, shingles):
        parts = [np.frombuffer(s, np.uint64) for s in shingles]
        x, y = set_forest(np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(parts))
        node = np.array(node, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], ["a", "b"])

    def run(batches):
        current, node, shingles = None, [], []
        for batch in batches:
            for part, own, s in zip(*(c.to_pylist() for c in batch.columns)):
                if part != current and len(node) > 1:
                    yield linked(node, shingles)
                if part != current:
                    current, node, shingles = part, [], []
                node.append(own)
                shingles.append(s)
        if len(node) > 1:
            yield linked(node, shingles)

    return checkpointed(rows.mapInArrow(run, "a long, b long"))


def _weight():
    """The share of a task that a set takes, in shingles."""
    return F.greatest(F.col("n"), F.lit(TASK_SHINGLES // TASK_MEMBERS))


def links(docs: DataFrame, distinct: DataFrame, groups: DataFrame, shingle: int, seed: int) -> DataFrame:
    """Edges (a, b) that connect the nodes that link, inside the groups (node, root) of candidates."""
    ends = groups.select("node", "root").union(groups.select("root", "root")).distinct()
    members = distinct.select("node", "n", "least_id").join(ends, "node")
    weights = checkpointed(members.groupBy("root").agg(F.ceil(F.sum(_weight()) / TASK_SHINGLES).alias("parts"), F.count("*").alias("members")))
    members = members.join(weights, "root").select("root", "node", "n", "parts", "members", F.col("least_id").alias("_id"))
    rows = docs.join(members, F.col("doc_id") == F.col("_id")).select("text", "root", "node", "n", "parts", "members")

    def run(batches):
        for batch in batches:
            node = batch.column(2).to_pylist()
            found, sets = [], []
            for rows, head, h in shingle_sets(batch.column(0), shingle, seed):
                for row, a, b in zip(rows.tolist(), head[:-1], head[1:]):
                    if name_of(h[a:b]) == node[row] % (1 << 64):  # not another text of that id
                        found.append(row)
                        sets.append(h[a:b].tobytes())
            kept = batch.select(["root", "node", "n", "parts", "members"]).take(pa.array(found, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sets, pa.binary())], [*kept.schema.names, "shingles"])

    sets = checkpointed(rows.mapInArrow(run, "root long, node long, n long, parts long, members long, shingles binary"))
    own = F.pmod(F.xxhash64("node"), "parts")
    every = F.pmod(F.xxhash64("node", F.lit(1)), "members") < TIES
    part = F.when((F.col("parts") > 1) & every, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(own))
    edges = confirmed(sets.withColumn("part", F.explode(part)), "root", "part")
    heavy = sets.where("parts > 1")
    if not heavy.limit(1).count():
        return edges
    return edges.union(confirmed(apart(heavy, edges), "root", "i", "j"))


def apart(sets: DataFrame, edges: DataFrame) -> DataFrame:
    """The sets of large groups dealt to pairs (i, j) of parts, so that each set outside
    its group's largest cluster meets all sets of the group."""
    named = components(edges).select(F.col("node").alias("_n"), F.col("root").alias("cluster"))
    sets = sets.join(named, F.col("node") == F.col("_n"), "left").withColumn("cluster", F.coalesce("cluster", "node")).drop("_n")
    sizes = checkpointed(sets.groupBy("root", "cluster").agg(F.sum(_weight()).alias("n")))
    largest = sizes.groupBy("root").agg(F.max(F.struct("n", "cluster")).alias("top"), F.sum("n").alias("all"))
    ceil = lambda n: F.ceil(n / TASK_SHINGLES)
    largest = largest.select(F.col("root").alias("_r"), F.col("top.cluster").alias("main"), ceil(F.col("top.n")).alias("p"), ceil(F.col("all") - F.col("top.n")).alias("q"))
    sets = sets.join(checkpointed(largest.where("q > 0")), F.col("root") == F.col("_r"))
    inside = F.col("cluster") == F.col("main")
    own = F.when(inside, F.pmod(F.xxhash64("node"), "p")).otherwise(F.col("p") + F.pmod(F.xxhash64("node"), "q"))
    others = F.sequence(F.when(inside, F.col("p")).otherwise(0), F.col("p") + F.col("q") - 1)
    sets = sets.select("root", "node", "shingles", own.alias("own"), F.explode(others).alias("other"))
    return sets.select("root", "node", "shingles", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def near_copies(docs: DataFrame, distance: int = 6, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42, family: int = 4) -> DataFrame:
    """doc_id and component_id, the smallest id of its group, of every row."""
    require(docs, id_col, text_col)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = checkpointed(fingerprinted(docs, shingle, seed, family))
    names = [f"fp{k}" for k in range(family)]
    distinct = checkpointed(prints.groupBy("node", "n", *names).agg(F.min("doc_id").alias("least_id")))
    known = distinct.where("n > 0 AND least_id IS NOT NULL")
    groups = components(union_of([candidates(known, distance, family, k) for k in range(family)]))
    roots = components(links(docs, known, groups, shingle, seed))
    classes = distinct.select("node", "least_id").join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left")
    classes = classes.select("node", "least_id", F.coalesce("root", "node").alias("root"))
    named = checkpointed(classes.groupBy("root").agg(F.min("least_id").alias("component_id")).withColumnRenamed("root", "r"))
    classes = classes.join(named, F.col("root") == F.col("r")).select(F.col("node").alias("_n"), "component_id")
    return prints.join(classes, F.col("node") == F.col("_n")).select("doc_id", "component_id")


def one_of_each(docs: DataFrame, distance: int = 6, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42, family: int = 4) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest id.
    Rows that share an id, or have none, are treated as by ``simhash.one_of_each``."""
    return first_rows(docs, near_copies(docs, distance, id_col, text_col, shingle, seed, family), id_col, text_col)

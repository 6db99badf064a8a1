"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: 64 bits, a bit set where over half of the shingles' XXH64 values have
it. Two fingerprints link at ``distance`` or fewer differing bits.

The index has upper nodes that factor out masked bit patterns. The 64 bits are cut
into ``distance + 2`` segments; two fingerprints that link agree on at least two whole
segments, so each fingerprint hangs under one upper node for every pair of segments
(mask) with the pattern it has there, and every link meets under some upper node. For
very many fingerprints masks have more, shorter segments and longer patterns in all
(``kept_segments``), so that nodes do not grow with the input.
Below an upper node, fingerprints are sorted by Gray rank and cut into leaves; each
inner node holds the bits all its members share. Pairs of nodes are compared from the
top, the differences in shared bits add up on the way down, and a pair of groups goes
as a whole once its sum is above the distance; where even all unshared bits cannot
reach above it, the two groups link as a whole without a look at their members.

An upper node with more members than BLOCK passes them on in Gray-order blocks, and
the pairs of blocks are dealt out to all tasks. What leaves a task is a spanning
forest of the links, not the pairs; components join them up exactly.

Edge cases: null, empty and blank texts have fingerprint zero, linked like any other;
a text with fewer words than a shingle is one shingle; repeated rows share a component;
a null doc_id gets the component of its fingerprint; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .common import checkpointed, require, shuffle_width
from .components import components, local_forest, spanning

BLOCK = 4096
LEAF = 16
FANOUT = 8
_LANE = np.uint64(0x0101010101010101)


def fingerprints_of(column: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """uint64 fingerprint of each text."""
    return fingerprint_family(column, shingle, seed, 1)[0]


def fingerprint_family(column: pa.Array, shingle: int, seed: int, n: int) -> np.ndarray:
    """n fingerprints of each text: the first from the shingles' hashes, the others from
    the hashes mixed anew, so their bits are independent."""
    out = np.zeros((n, len(column)), np.uint64)
    for docs, head, h in shingle_hashes(column, shingle, seed):
        out[:, docs] = family_of(h, head, n)
    return out


def family_of(h: np.ndarray, head: np.ndarray, n: int) -> np.ndarray:
    salts = [np.uint64(k * int(tc.BASE) % (1 << 64)) for k in range(n)]
    return np.stack([majority(tc.mix(h + salt) if k else h, head) for k, salt in enumerate(salts)])


def shingle_hashes(column: pa.Array, shingle: int, seed: int):
    """(rows, head, h) of runs of rows with words: row rows[d] has the shingles' hashes
    h[head[d]:head[d + 1]], repeats included."""
    digest = xxhash.xxh64_intdigest
    for first, end, data, offsets in tc.chunks(column):
        if not len(data):
            continue
        w = tc.Words(tc.LOWER[data], offsets, tc.SPACE_WORD)
        if not len(w.starts):
            continue
        owner = w.doc
        keep = w.inside.copy()
        keep[w.ends[w.ends < offsets[owner + 1]]] = True
        flat = np.where(w.inside, w.data, np.uint8(32))[keep].tobytes()
        at = np.zeros(len(data) + 1, np.int64)
        np.cumsum(keep, out=at[1:])
        starts, ends = at[w.starts], at[w.ends]
        docs = np.flatnonzero(w.counts)
        counts = np.maximum(w.counts[docs] - shingle + 1, 1)
        span = np.minimum(w.counts[docs], shingle) - 1
        head = np.concatenate([[0], np.cumsum(counts)])
        i = np.repeat(w.bounds[docs] - head[:-1], counts) + np.arange(head[-1])
        s, e = starts[i].tolist(), ends[i + np.repeat(span, counts)].tolist()
        yield first + docs, head, np.array([digest(flat[a:b], seed) for a, b in zip(s, e)], np.uint64)


def majority(h: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Bits set in over half of h[head[d]:head[d + 1]], for every d; no range is empty."""
    counts = np.diff(head)
    pieces = -(-counts // 255)
    total = np.concatenate([[0], np.cumsum(pieces)])
    cut = np.repeat(head[:-1], pieces) + 255 * (np.arange(total[-1]) - np.repeat(total[:-1], pieces))
    fp = np.zeros(len(counts), np.uint64)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANE, cut)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), total[:-1], axis=0)
        for j in range(8):
            fp |= (2 * sums[:, j] > counts).astype(np.uint64) << np.uint64(8 * j + k)
    return fp


def fingerprinted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, family: int = 1) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long) and fp1, fp2 ... for a larger family."""
    require(docs, id_col, text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["fp", *(f"fp{k}" for k in range(1, family))]

    def run(batches):
        for batch in batches:
            fps = fingerprint_family(batch.column(1), shingle, seed, family).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, fps)], ["doc_id", *names])

    schema = slim.select("doc_id").schema
    for name in names:
        schema = schema.add(name, "long")
    return slim.mapInArrow(run, schema)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each value in the reflected Gray sequence."""
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


def gray_order(fps: np.ndarray) -> np.ndarray:
    """Order by Gray rank of the rows of ``fps``, the words of a row being one number."""
    ranks, odd = [], np.zeros(len(fps), bool)
    for word in fps.T:
        rank = gray_rank(word)
        ranks.append(np.where(odd, ~rank, rank))
        odd ^= (np.bitwise_count(word) & 1).astype(bool)
    return np.lexsort(ranks[::-1])


def _ones(x: np.ndarray, wide: bool) -> np.ndarray:
    """Bits set in each fingerprint; a wide one has several words."""
    n = np.bitwise_count(x)
    return n.sum(axis=-1, dtype=np.int64) if wide else n


class GrayIndex:
    """Hierarchy over fingerprints sorted by Gray rank; ``levels[0]`` are the leaves.
    A fingerprint is one word, or a row of several."""

    def __init__(self, sorted_fps: np.ndarray):
        self.fps = sorted_fps
        self.levels = []
        cut = np.arange(0, len(sorted_fps), LEAF)
        low, high = np.bitwise_and.reduceat(sorted_fps, cut, axis=0), np.bitwise_or.reduceat(sorted_fps, cut, axis=0)
        while True:
            self.levels.append((~(low ^ high), low))
            if len(low) == 1:
                return
            cut = np.arange(0, len(low), FANOUT)
            low, high = np.bitwise_and.reduceat(low, cut, axis=0), np.bitwise_or.reduceat(high, cut, axis=0)

    def leaf_range(self, level: int, node: int) -> tuple[int, int]:
        width = LEAF * FANOUT**level
        return node * width, min(len(self.fps), (node + 1) * width)

    def single(self, level: int, root: np.ndarray) -> np.ndarray:
        """The component of each node of a level whose members are all in one, else -1."""
        cut = np.arange(0, len(root), LEAF * FANOUT**level)
        low = np.minimum.reduceat(root, cut)
        return np.where(low == np.maximum.reduceat(root, cut), low, -1)


def _children(nodes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    grown = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
    parent = np.repeat(np.arange(len(nodes)), FANOUT)
    return grown[grown < limit], parent[grown < limit]


def linked(left: GrayIndex, right: GrayIndex, distance: int, same: bool, step: int = 1 << 14, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (position in left, position in right) that connect everything the links connect.

    ``same``: both are one index, and pairs are taken once. ``root``: components known before,
    of left's positions and, if they are two, right's after them; pairs inside one are left out."""
    found_a, found_b = [], []
    top = max(len(left.levels), len(right.levels)) - 1
    wide, shift = left.fps.ndim > 1, 0 if same else len(left.fps)
    lift = lambda index, k: index.levels[min(k, len(index.levels) - 1)]  # noqa: E731  a lower tree waits at its root
    start = (np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, *left.fps.shape[1:]), np.uint64))
    todo = [(top, *start)]
    while todo:
        k, a, b, differs, seen = todo.pop()
        if len(a) > step:
            half = len(a) // 2
            todo += [(k, a[:half], b[:half], differs[:half], seen[:half]), (k, a[half:], b[half:], differs[half:], seen[half:])]
            continue
        (mask_a, bits_a), (mask_b, bits_b) = lift(left, k), lift(right, k)
        shared = mask_a[a] & mask_b[b]
        differs = differs + _ones((bits_a[a] ^ bits_b[b]) & shared & ~seen, wide)
        stay = differs <= distance
        if root is not None:
            of_a = left.single(min(k, len(left.levels) - 1), root[: len(left.fps)])[a]
            of_b = right.single(min(k, len(right.levels) - 1), root[shift:])[b]
            stay &= (of_a != of_b) | (of_a < 0)
        a, b, differs, shared = a[stay], b[stay], differs[stay], shared[stay]
        if not len(a):
            continue
        close = differs + _ones(~shared, wide) <= distance
        first = len(found_a)
        for x, y in zip(a[close].tolist(), b[close].tolist()):
            (p, q), (r, s) = left.leaf_range(min(k, len(left.levels) - 1), x), right.leaf_range(min(k, len(right.levels) - 1), y)
            found_a += [np.full(s - r, p), np.arange(p, q)]
            found_b += [np.arange(r, s), np.full(q - p, r)]
        a, b, differs, shared = a[~close], b[~close], differs[~close], shared[~close]
        if k == 0:
            i = a[:, None, None] * LEAF + np.arange(LEAF)[:, None]
            j = b[:, None, None] * LEAF + np.arange(LEAF)
            i, j = np.broadcast_arrays(i, j)
            valid = (i < len(left.fps)) & (j < len(right.fps))
            if same:
                valid &= i < j
            i, j = i[valid], j[valid]
            near = _ones(left.fps[i] ^ right.fps[j], wide) <= distance
            found_a.append(i[near])
            found_b.append(j[near])
        if root is not None and len(found_a) > first:
            x, y = np.concatenate(found_a[first:]), np.concatenate(found_b[first:])
            apart = root[x] != root[y + shift]
            found_a[first:], found_b[first:] = [x[apart]], [y[apart]]
            root = spanning(len(root), x[apart], y[apart] + shift, root)
        if k == 0:
            continue
        grow_a, grow_b = k < len(left.levels), k < len(right.levels)
        if grow_a:
            a, parent = _children(a, len(left.levels[k - 1][0]))
            b, differs, shared = b[parent], differs[parent], shared[parent]
        if grow_b:
            b, parent = _children(b, len(right.levels[k - 1][0]))
            a, differs, shared = a[parent], differs[parent], shared[parent]
        if same:
            once = a <= b
            a, b, differs, shared = a[once], b[once], differs[once], shared[once]
        if len(a):
            todo.append((k - 1, a, b, differs, shared))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def forest(fps: np.ndarray, groups: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links inside each group.

    fps are sorted by group, then by Gray rank."""
    n = len(fps)
    cut = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    sizes = np.diff(np.append(cut, n))
    size_of = np.repeat(sizes, sizes)
    a, b = [], []
    small = np.flatnonzero((size_of > 1) & (size_of <= LEAF))  # one leaf: members are compared directly
    f, g = fps[small], np.repeat(np.arange(len(cut)), sizes)[small]
    for k in range(1, LEAF):
        if k >= len(f):
            break
        near = (g[k:] == g[:-k]) & (np.bitwise_count(f[k:] ^ f[:-k]) <= distance)
        a.append(small[:-k][near])
        b.append(small[k:][near])
    for i in np.flatnonzero(sizes > LEAF):
        index = GrayIndex(fps[cut[i] : cut[i] + sizes[i]])
        x, y = linked(index, index, distance, True)
        a.append(cut[i] + x)
        b.append(cut[i] + y)
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    root = spanning(n, np.concatenate(a), np.concatenate(b))
    node = np.flatnonzero(root != np.arange(n))
    return node, root[node]


def masks_of(distance: int, kept: int = 2) -> list[int]:
    """Masks of all choices of ``kept`` from distance + kept segments of 64 bits: two
    fingerprints that link agree on all bits of one of them."""
    parts = distance + kept
    edge = [round(64 * i / parts) for i in range(parts + 1)]
    segment = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(parts)]
    return [sum(chosen) for chosen in combinations(segment, kept)]


#: Members of an upper node to expect at most, and segments of a mask at most.
NODE_MEMBERS, MOST_KEPT = 64, 4


def kept_segments(n: int, distance: int) -> int:
    """Segments of a mask for n fingerprints: the fewest whose patterns are long enough
    that upper nodes stay small; more segments are more masks."""
    kept = 2
    while kept < MOST_KEPT and n >> (64 * kept // (distance + kept)) > NODE_MEMBERS:
        kept += 1
    return kept


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def rank_of(name: str):
    """Gray rank of a column of fingerprints, as a long that sorts as the rank does."""
    rank = F.col(name)
    for s in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, s))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def links(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column fp) that connect all that link."""
    width = max(2, shuffle_width(fps.sparkSession))
    masks = F.array(*[F.lit(_long(m)) for m in masks_of(distance, kept_segments(fps.count(), distance))])
    rows = fps.select("fp", rank_of("fp").alias("rank"), F.posexplode(masks).alias("mask", "bits"))
    rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("bits")).alias("pattern"), "rank", "fp")
    rows = rows.repartition(width, "mask", "pattern").sortWithinPartitions("mask", "pattern", "rank").select("mask", "pattern", "fp")

    def blocks(mask, pattern, members, first):
        for i in range(0, len(members), BLOCK):
            yield 1, int(mask), int(pattern), first + i // BLOCK, 0, 0, members[i : i + BLOCK].tobytes()

    def whole_nodes(mask, pattern, fp, first):
        """Edges and blocks of whole upper nodes; of the first, ``first`` blocks have gone before."""
        cut = np.flatnonzero(np.append(True, (mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])))
        sizes = np.diff(np.append(cut, len(fp)))
        heavy = sizes > BLOCK
        heavy[0] |= first > 0
        for i in np.flatnonzero(heavy):
            yield from blocks(mask[cut[i]], pattern[cut[i]], fp[cut[i] : cut[i] + sizes[i]], 0 if i else first)
        light = np.repeat(~heavy, sizes)
        x, y = forest(fp[light], np.repeat(np.arange(len(cut)), sizes)[light], distance)
        signed = fp[light].view(np.int64)
        yield from ((0, 0, 0, 0, int(p), int(q), None) for p, q in zip(signed[x], signed[y]))

    def batch_of(rows):
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["kind", "mask", "pattern", "block", "a", "b", "members"])

    def run(batches):
        held, first = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            rows = rows if held is None else [np.concatenate(pair) for pair in zip(held, rows)]
            mask, pattern, fp = rows[0], rows[1], rows[2].view(np.uint64)
            cut = int(np.argmax((mask == mask[-1]) & (pattern == pattern[-1])))  # where the last node, still open, begins
            out = []
            if cut:
                out += whole_nodes(mask[:cut], pattern[:cut], fp[:cut], first)
                first = 0
            mask, pattern, fp = mask[cut:], pattern[cut:], fp[cut:]
            if len(fp) > 4 * BLOCK:
                full = (len(fp) - 1) // BLOCK * BLOCK  # a row stays to tell the node
                out += blocks(mask[0], pattern[0], fp[:full], first)
                first += full // BLOCK
                mask, pattern, fp = mask[full:], pattern[full:], fp[full:]
            held = [mask, pattern, fp.view(np.int64)]
            if out:
                yield batch_of(out)
        if held is not None and (out := list(whole_nodes(held[0], held[1], held[2].view(np.uint64), first))):
            yield batch_of(out)

    schema = "kind int, mask int, pattern long, block int, a long, b long, members binary"
    found = checkpointed(rows.mapInArrow(run, schema))
    edges = found.where("kind = 0").select("a", "b")
    heavy = found.where("kind = 1")
    if heavy.limit(1).count():
        edges = edges.union(block_links(heavy, distance, width))
    return local_forest(edges)  # masks find the same links again and again


def block_links(blocks: DataFrame, distance: int, width: int) -> DataFrame:
    """Edges from all pairs of blocks of the same upper node; the pairs are dealt out evenly."""
    count = blocks.groupBy("mask", "pattern").agg((F.max("block") + 1).alias("n"))
    count = count.select(F.col("mask").alias("m"), F.col("pattern").alias("p"), "n")
    pairs = blocks.join(count, (F.col("mask") == F.col("m")) & (F.col("pattern") == F.col("p")))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    pairs = pairs.select("mask", "pattern", "block", "members", other.alias("other"))
    pairs = pairs.groupBy("mask", "pattern", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(F.struct("block", "members")).alias("sides"))

    def run(batches):
        for batch in batches:
            for sides in batch.column(0).to_pylist():
                fps = [np.frombuffer(s["members"], np.uint64) for s in sorted(sides, key=lambda s: s["block"])]
                fps = [f[np.argsort(gray_rank(f), kind="stable")] for f in fps]
                left, right = GrayIndex(fps[0]), GrayIndex(fps[-1])
                x, y = linked(left, right, distance, len(fps) == 1)
                shift = len(fps[0]) if len(fps) == 2 else 0
                both = np.concatenate(fps)
                root = spanning(len(both), x, y + shift)
                node = np.flatnonzero(root != np.arange(len(both)))
                signed = both.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed[node]), pa.array(signed[root[node]])], ["a", "b"])

    return checkpointed(pairs.select("sides").repartition(width).mapInArrow(run, "a long, b long"))


def family_roots(distinct: DataFrame, distance: int, family: int) -> DataFrame:
    """(node, root) of first fingerprints, where any fingerprint of the family links two texts.

    Vertices are (place in the family, fingerprint). A text ties its fingerprints
    together; the tie matters only where the later one links or is shared."""
    vertex = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).alias("fp"))
    edges, ties = [], []
    for k in range(family):
        own = distinct.select(F.col(f"fp{k or ''}").alias("fp")).distinct()
        edges.append(links(own, distance).select(vertex(k, "a").alias("a"), vertex(k, "b").alias("b")))
        if k:
            ties.append(distinct.select(vertex(0, "fp").alias("a"), vertex(k, f"fp{k}").alias("b")).distinct())
    edges, ties = (checkpointed(union_of(x)) for x in (edges, ties))
    shared = ties.groupBy("b").count().where("count > 1").select("b")
    used = edges.select("a").union(edges.select("b")).toDF("b").union(shared).distinct()
    roots = components(edges.union(ties.join(used, "b", "left_semi").select("a", "b")))
    return roots.where("node.k = 0").select(F.col("node.fp").alias("node"), "root")


def union_of(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def near_duplicates(docs: DataFrame, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, family: int = 1) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id of every row.

    With ``family`` above 1, texts link where any of so many independent fingerprints
    differ in at most ``distance`` bits; the fingerprint returned is the first."""
    prints = checkpointed(fingerprinted(docs, id_col, text_col, shingle, seed, family))
    names = [c for c in prints.columns if c.startswith("fp")]
    distinct = prints.groupBy(*names).agg(F.min("doc_id").alias("least_id"))
    if family > 1:
        distinct = checkpointed(distinct)
        roots = family_roots(distinct, distance, family)
        distinct = distinct.groupBy("fp").agg(F.min("least_id").alias("least_id"))
        own = F.struct(F.lit(0).alias("k"), F.col("fp").alias("fp"))
    else:
        distinct = checkpointed(distinct)
        roots = components(links(distinct.select("fp"), distance))
        own = F.col("fp")
    classes = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", own).alias("root"))
    # A plain table on this side lets the planner split a very large component in the join.
    named = checkpointed(classes.groupBy("root").agg(F.min("least_id").alias("component_id")).withColumnRenamed("root", "r"))
    classes = classes.join(named, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id")
    out = prints.join(classes, F.col("fp") == F.col("f"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, family: int = 1) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the
    smallest id. Where rows share that id, the one with the least text hash stays; rows
    without an id stay, as nothing tells them apart."""
    return first_rows(docs, near_duplicates(docs, distance, id_col, text_col, shingle, seed, family), id_col, text_col)


def first_rows(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, by the component_id that ``found`` has for each doc_id.
    Input columns may have any names."""
    found = checkpointed(found)
    kept = found.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    # The input's columns go into one struct, so that none can clash with a column made here.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"))
    out = held.join(kept, F.col("id") == F.col("kept_id"))
    if found.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").limit(1).count():
        first = Window.partitionBy("id").orderBy("text_hash", F.hash("row"))
        out = out.withColumn("number", F.row_number().over(first)).where("number = 1")
    out = out.select("row")
    if found.where("doc_id IS NULL").limit(1).count():
        out = out.union(held.where("id IS NULL").select("row"))
    return out.select("row.*")

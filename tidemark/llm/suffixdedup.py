"""Removal of long repeated byte strings by blockwise suffix sorting with a difference cover.

A byte goes when a string of ``n`` (``min_length``) bytes that covers it starts at some
other place too, in the same document or another. Matches never cross documents. Only
the first n bytes of a suffix matter, so a suffix is such a string here.

Suffixes are sorted one bucket at a time, by their bytes (``sorted_suffixes``):

 1. A difference cover D modulo v holds, for any two places i and j, an offset d < v with
    both (i + d) mod v and (j + d) mod v in D. The cover samples of the bucket's text are
    ranked first, by their n - v + 1 bytes.
 2. Suffixes are sorted by their first v - 1 bytes. Two that tie there are compared by the
    ranks of their samples at the common offset d, however long the tie, and only then by
    their last v - 1 bytes; the sample covers all bytes between.
 3. Neighbours of that order that tie in all three parts are equal strings.

Which bucket a suffix is in follows from its bytes: the least hash of the n - v + 1 byte
strings in it. Neighbouring suffixes mostly share it, so a bucket is not a list of suffixes
but of segments, runs of starts of one key with the bytes they cover. A bucket gets only
segments whose key occurs again, and equal segments of a block of text once:

 1. Texts are put into blocks of one representative each (a text that occurs twice is
    repeated as a whole), kept as a table bucketed by block, so the text does not move again.
 2. Blocks tell the buckets the keys of their segments, each once, and hear which of them
    other blocks have too (``told``).
 3. A key with more than HEAVY segments, as of a very common line in ever new surroundings,
    would be one large group. Its segments are cut into single strings with keys of their
    own, which are told in the same way; of these each block sends a copy at most.
 4. Segments go to their buckets, are sorted there, and a bit for each start goes back.

Hashes decide only what meets; equality is decided by bytes. The number of buckets follows
from the bytes of text, so what a task holds does not: one row of a block (ROW_BYTES, or
one longer text, with some tens of bytes of working space for each of its bytes) or one
bucket (about BUCKET_BYTES of text, of which only repeated parts are there).

Edge cases: null and empty texts have no bytes; texts shorter than min_length stay whole;
repeated rows are copies of each other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import checkpointed, require, shuffle_width, small_batches

ROW_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
#: Bytes of text whose segments are found at once, about.
STEP_BYTES = 1 << 18
#: Segments of one key that are sorted as they are; with more, they are cut into single strings.
HEAVY = 1024
#: Starts of a segment and of a part of a bucket that is sorted at once.
RUN, SORT_STARTS = 1024, 1 << 15
ALONE, SHARED, CUT = 0, 1, 2


def cover(min_length: int) -> tuple[int, np.ndarray]:
    """(v, D): the powers of two modulo 73 or 7, which are perfect difference sets."""
    v = 73 if min_length >= 128 else 7
    if min_length < v + 8:
        raise ValueError("min_length is too small for a difference cover")
    return v, np.unique([pow(2, i, v) for i in range(9)])


class Cover:
    """The cover of a length: core is the length of a sample, ``offset[r, s]`` the least
    offset at which places of residues r and s both have a sample."""

    def __init__(self, min_length: int):
        self.n, (self.v, self.set) = min_length, cover(min_length)
        self.core = min_length - self.v + 1
        self.inside = np.zeros(self.v, bool)
        self.inside[self.set] = True
        r = np.arange(self.v)
        both = self.inside[(r[:, None, None] + r) % self.v] & self.inside[(r[None, :, None] + r) % self.v]
        self.offset = np.argmax(both, axis=2)


def strings(data: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each start on, as fixed-width strings that compare by their bytes."""
    if not len(starts):
        return np.zeros(0, f"S{n}")
    view = np.lib.stride_tricks.sliding_window_view(data, n)
    return np.ascontiguousarray(view[starts]).view(f"S{n}").ravel()


def dense_ranks(values: np.ndarray) -> np.ndarray:
    order = np.argsort(values, kind="stable")
    ranks = np.empty(len(values), np.int64)
    ranks[order] = np.cumsum(np.append(False, values[order[1:]] != values[order[:-1]])) if len(values) else 0
    return ranks


def merge_sorted(groups: np.ndarray, less) -> np.ndarray:
    """Order of items that sorts them inside each group (groups come in runs); ``less(x, y)``
    compares items pairwise. A bottom-up merge sort of all groups side by side."""
    n = len(groups)
    order = np.arange(n)
    cut = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    sizes = np.diff(np.append(cut, n))
    base, size = np.repeat(cut, sizes), np.repeat(sizes, sizes)
    local = np.arange(n) - base
    width = 1
    while width < sizes.max(initial=1):
        run = local // width
        other = (run ^ 1) * width
        low = np.minimum(other, size)
        first, high = low.copy(), np.minimum(other + width, size)
        right = (run & 1).astype(bool)
        todo = np.flatnonzero(low < high)
        while len(todo):  # how many of the other run come before the item
            mid = (low[todo] + high[todo]) // 2
            x, y = order[todo], order[base[todo] + mid]
            before = np.where(right[todo], ~less(x, y), less(y, x))
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
            todo = todo[low[todo] < high[todo]]
        place = base + (run // 2) * 2 * width + (local - run * width) + (low - first)
        order[place] = order.copy()
        width *= 2
    return order


def sorted_suffixes(c: Cover, data: np.ndarray, bounds: np.ndarray, starts: np.ndarray, residues: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): the suffixes at ``starts`` in the order of their n bytes, and whether
    each equals the one before it. ``bounds``: pieces of ``data`` that hold the suffixes
    whole; ``residues``: the residue of the first place of each piece."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    piece = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    residue = (residues[piece] + np.arange(len(data)) - bounds[piece]) % c.v
    heads = strings(data, starts, c.v - 1)
    order = np.argsort(heads, kind="stable")
    same = np.append(False, heads[order[1:]] == heads[order[:-1]])
    tied = same.copy()
    tied[:-1] |= same[1:]
    at = np.flatnonzero(tied)
    if not len(at):
        return order, same
    items = order[at]
    first = starts[items]
    # Samples inside the tied suffixes alone.
    reach = np.bincount(first, minlength=len(data) + 1) - np.bincount(first + c.v, minlength=len(data) + 1)[: len(data) + 1]
    samples = np.flatnonzero((np.cumsum(reach)[:-1] > 0) & c.inside[residue])
    rank = np.zeros(len(data), np.int64)
    rank[samples] = dense_ranks(strings(data, samples, c.core))
    tails = dense_ranks(strings(data, first + c.core, c.v - 1))

    def keys(x, y):
        i, j = first[x], first[y]
        d = c.offset[residue[i], residue[j]]
        return rank[i + d], rank[j + d]

    def less(x, y):
        p, q = keys(x, y)
        return (p < q) | ((p == q) & (tails[x] < tails[y]))

    inner = merge_sorted(np.cumsum(~same[at]), less)
    order[at] = items[inner]
    p, q = keys(inner[1:], inner[:-1])
    equal = np.append(False, (p == q) & (tails[inner[1:]] == tails[inner[:-1]]))
    same[at] &= equal
    return order, same


def repeated_starts(c: Cover, texts: list[bytes], residues: np.ndarray) -> list[np.ndarray]:
    """For each piece of text, whether the string at each of its starts occurs again."""
    counts = np.array([len(t) - c.n + 1 for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(counts + c.n - 1)])
    head = np.cumsum(counts) - counts
    starts = np.repeat(bounds[:-1] - head, counts) + np.arange(counts.sum())
    order, same = sorted_suffixes(c, data, bounds, starts, residues)
    again = np.zeros(len(starts), bool)
    again[order] = same
    again[order[:-1][same[1:]]] = True
    return np.split(again, head[1:])


def text_blocks(docs: DataFrame, text_col: str, min_length: int, name: str, width: int) -> DataFrame:
    """The distinct texts of at least min_length bytes as a table bucketed by block: block,
    row, digests (16 bytes each), copied (a byte each: does the text occur again?), lengths
    (int64), data and n_bytes."""
    spark = docs.sparkSession

    def local(batches):
        seen: dict[bytes, bool] = {}
        for batch in batches:
            block, digest, text = [], [], []
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                if t is None or len(t) < min_length:
                    continue
                d = hashlib.md5(t).digest()
                known = seen.get(d)
                if known is None or not known:
                    seen[d] = known is not None
                    block.append(int.from_bytes(d[:8], "big") % width)
                    digest.append(d)
                    text.append(t if known is None else None)  # the second time a mark is enough
            if block:
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(digest, pa.binary()), pa.array(text, pa.binary())], ["block", "digest", "text"])

    rows = docs.select(F.col(text_col)).mapInArrow(local, "block int, digest binary, text binary")
    rows = rows.repartition(width, "block").sortWithinPartitions("block", "digest", F.col("text").isNull())

    def gather(batches):
        block, number, held, size, last = None, 0, [], 0, None

        def flush():
            digests, copied, texts = zip(*held)
            values = [b"".join(digests), bytes(copied), np.array([len(t) for t in texts], np.int64).tobytes(), b"".join(texts)]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([number], pa.int32()), *[pa.array([v], pa.binary()) for v in values], pa.array([size], pa.int64())], ["block", "row", "digests", "copied", "lengths", "data", "n_bytes"])

        for batch in batches:
            for b, d, t in zip(*(c.to_pylist() for c in batch.columns)):
                if d == last:
                    held[-1][1] = 1
                    continue
                if held and (b != block or size >= ROW_BYTES):
                    yield flush()
                    number, held, size = (0 if b != block else number + 1), [], 0
                block, last = b, d
                held.append([d, 0, t])
                size += len(t)
        if held:
            yield flush()

    blocks = rows.mapInArrow(gather, "block int, row int, digests binary, copied binary, lengths binary, data binary, n_bytes long")
    blocks.write.option("compression", "zstd").bucketBy(width, "block").saveAsTable(name)
    return spark.table(name)


_PLACE = np.uint64((1 << 32) - 1)


def least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n values in a row, by doubling."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return values if width == n else np.minimum(values[: len(values) - (n - width)], values[n - width :])


class Segments:
    """The segments of a row of texts: first (place of the first start), count (starts),
    key, residue (of the first start in its text) and inner (the key's string occurs
    twice in the segment, so it may hold repeats by itself)."""

    def __init__(self, c: Cover, data: np.ndarray, lengths: np.ndarray):
        self.c, self.data = c, data
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        first, count, key, residue, inner = [], [], [], [], []
        row = 0
        while row < len(lengths):
            end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + STEP_BYTES, "right")) - 1)
            base = int(bounds[row])
            cut = bounds[row : end + 1] - base
            for x, found in zip((first, count, key, residue, inner), self._chunk(data[base : bounds[end]], cut)):
                x.append(found + base if x is first else found)
            row = end
        self.first, self.count, self.residue = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (first, count, residue))
        self.key = np.concatenate([np.zeros(0, np.uint64), *key])
        self.inner = np.concatenate([np.zeros(0, bool), *inner])

    def _chunk(self, data, bounds):
        c, size = self.c, len(data)
        if size < c.n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64), none, none.astype(bool)
        h = tc.run_hashes(data, c.core)
        # The least high half in each window of v strings, of equal ones the leftmost or the rightmost.
        high, place = h & ~_PLACE, np.arange(len(h), dtype=np.uint64)
        left = (least(high | place, c.v) & _PLACE).view(np.int64)
        right = (_PLACE - (least(high | (_PLACE - place), c.v) & _PLACE)).view(np.int64)
        ends = np.repeat(bounds[1:], np.diff(bounds))[: len(left)]
        starts = np.flatnonzero(np.arange(c.n, len(left) + c.n) <= ends)
        if not len(starts):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.uint64), none, none.astype(bool)
        key = h[left[starts]]
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] != starts[:-1] + 1) | (key[1:] != key[:-1])
        head = np.flatnonzero(new)
        run = np.arange(len(starts)) - np.repeat(head, np.diff(np.append(head, len(starts))))
        head = np.flatnonzero(run % RUN == 0)  # long runs, as of one letter, are cut
        last = np.append(head[1:], len(starts)) - 1
        first = starts[head]
        doc = np.searchsorted(bounds, first, "right") - 1
        return first, last - head + 1, key[head], (first - bounds[doc]) % c.v, left[first] != right[starts[last]]

    def take(self, which: np.ndarray) -> Segments:
        out = Segments.__new__(Segments)
        out.c, out.data = self.c, self.data
        out.first, out.count, out.key, out.residue, out.inner = (x[which] for x in (self.first, self.count, self.key, self.residue, self.inner))
        return out

    def text(self, i: int) -> bytes:
        return self.data[self.first[i] : self.first[i] + self.count[i] + self.c.n - 1].tobytes()

    def cut(self, which: np.ndarray) -> Segments:
        """The single strings of some segments, with keys of their own."""
        out = Segments.__new__(Segments)
        out.c, out.data = self.c, self.data
        count = self.count[which]
        of = np.repeat(which, count)
        step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        out.first, out.count = self.first[of] + step, np.ones(len(of), np.int64)
        out.residue, out.inner = (self.residue[of] + step) % self.c.v, np.zeros(len(of), bool)
        out.key = np.zeros(len(of), np.uint64)
        if len(of):
            lane = tc.lanes(self.data)
            for k in range(0, self.c.n - 7, 8):
                out.key = tc.mix(out.key * tc.BASE + lane[out.first + k])
            out.key = tc.mix(out.key * tc.BASE + lane[out.first + self.c.n - 8])
        return out

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct keys, number of each segment's key, segments of each key)."""
        return np.unique(self.key, return_inverse=True, return_counts=True)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((tc.mix(key ^ tc.BASE) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def dealt(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, used, heads): keys in order of their bucket; the buckets that have some, and where each begins."""
    bucket = bucket_of(key, buckets)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    heads = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    return order, bucket[heads], np.append(heads, len(key))


BLOB = "block int, row int, bucket int, payload binary"


def blob_batch(block, row, buckets, payloads):
    m = len(payloads)
    return pa.RecordBatch.from_arrays([pa.array([block] * m, pa.int32()), pa.array([row] * m, pa.int32()), pa.array(np.asarray(buckets, np.int32)), pa.array(payloads, pa.binary())], ["block", "row", "bucket", "payload"])


def answered(blobs: DataFrame, buckets: int, answer) -> DataFrame:
    """A blob in answer to each blob: ``answer`` gets the payloads of one bucket at a time."""
    rows = blobs.repartitionById(buckets, "bucket").sortWithinPartitions("bucket")

    def run(batches):
        current, held = None, []

        def bucket():
            block, row, payloads = zip(*held)
            return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(row, pa.int32()), pa.array([current] * len(held), pa.int32()), pa.array(answer(list(payloads)), pa.binary())], ["block", "row", "bucket", "payload"])

        for batch in batches:
            for block, row, b, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if held and b != current:
                    yield bucket()
                    held = []
                current = b
                held.append((block, row, payload))
        if held:
            yield bucket()

    return checkpointed(rows.mapInArrow(run, BLOB))


def by_row(blobs: DataFrame, width: int) -> DataFrame:
    """(block, row, flags): all blobs of a row of a block, partitioned as the blocks are."""
    flags = blobs.repartition(width, "block")
    return flags.groupBy("block", "row").agg(F.collect_list(F.struct("bucket", "payload")).alias("flags"))


def key_payloads(found: Segments, buckets: int):
    """(buckets, payloads): the distinct keys of a row with the number of segments of each, at most 65,535."""
    keys, _, n = found.keys()
    order, used, heads = dealt(keys, buckets)
    keys, n = keys[order].astype("<u8"), np.minimum(n[order], 65535).astype("<u2")
    return used, [keys[a:b].tobytes() + n[a:b].tobytes() for a, b in zip(heads[:-1], heads[1:])]


def key_answers(payloads: list[bytes], heavy: int) -> list[bytes]:
    """For each key of each blob a byte: does it occur in one blob alone, in several, in too many segments?"""
    sizes = [len(p) // 10 for p in payloads]
    keys = np.concatenate([np.frombuffer(p, "<u8", m) for p, m in zip(payloads, sizes)])
    n = np.concatenate([np.frombuffer(p, "<u2", m, 8 * m) for p, m in zip(payloads, sizes)]).astype(np.int64)
    order = np.argsort(keys)
    new = np.append(True, keys[order[1:]] != keys[order[:-1]])
    head = np.flatnonzero(new)
    code = np.where(np.diff(np.append(head, len(keys))) > 1, SHARED, ALONE)
    code[np.add.reduceat(n[order], head) > heavy] = CUT
    out = np.empty(len(keys), np.uint8)
    out[order] = code[np.cumsum(new) - 1]
    ends = np.cumsum(sizes)
    return [out[e - m : e].tobytes() for e, m in zip(ends, sizes)]


def codes_of(found: Segments, buckets: int, flags) -> np.ndarray:
    """The answer to each segment's key; SHARED also where the row itself has the key again."""
    keys, number, n = found.keys()
    order, used, heads = dealt(keys, buckets)
    places = {int(b): i for i, b in enumerate(used)}
    out = np.zeros(len(keys), np.uint8)
    for f in flags or ():
        i = places[f["bucket"]]
        out[order[heads[i] : heads[i + 1]]] = np.frombuffer(f["payload"], np.uint8)
    out = np.where((out == ALONE) & (n > 1), SHARED, out)[number]
    out[(out == ALONE) & found.inner] = SHARED
    return out


def candidates(c: Cover, lengths, data, buckets: int, told, told_cut) -> tuple[Segments, Segments]:
    """The segments of a row that may be repeated, and the single strings of those that are cut."""
    found = Segments(c, data, lengths)
    code = codes_of(found, buckets, told)
    cut = found.cut(np.flatnonzero(code == CUT))
    return found.take(code == SHARED), cut if told_cut is None else cut.take(codes_of(cut, buckets, told_cut) == SHARED)


class Pieces:
    """The distinct pieces of text of a row's candidates, in order of their buckets."""

    def __init__(self, found: list[Segments], buckets: int):
        self.found = found
        number: dict[bytes, int] = {}
        # The number of each candidate's piece, and how often the row has each piece.
        self.of = np.array([number.setdefault(s.text(i), len(number)) for s in found for i in range(len(s.first))], np.int64)
        self.times = np.bincount(self.of, minlength=len(number))
        self.texts = list(number)
        _, at = np.unique(self.of, return_index=True)
        self.key, self.residue, self.inner = (np.concatenate([getattr(s, name) for s in found])[at] for name in ("key", "residue", "inner"))
        self.order, self.used, self.heads = dealt(self.key, buckets)

    def payloads(self) -> list[bytes]:
        out = []
        for a, b in zip(self.heads[:-1], self.heads[1:]):
            at = self.order[a:b]
            texts = [self.texts[i] for i in at]
            parts = (np.array([len(t) for t in texts], "<u4"), self.residue[at].astype(np.uint8), self.inner[at].astype(np.uint8), self.key[at].astype("<u8"))
            raw = b"".join([len(at).to_bytes(4, "little"), *[p.tobytes() for p in parts], *texts])
            out.append(len(raw).to_bytes(8, "little") + _codec().compress(raw, asbytes=True))
        return out

    def starts(self, flags) -> np.ndarray:
        """The places of all starts whose string occurs again."""
        n = self.found[0].c.n
        again = [np.ones(len(t) - n + 1, bool) if k > 1 else None for t, k in zip(self.texts, self.times)]
        places = {int(b): i for i, b in enumerate(self.used)}
        for f in flags or ():
            i = places[f["bucket"]]
            at = self.order[self.heads[i] : self.heads[i + 1]]
            sizes = [len(self.texts[k]) - n + 1 for k in at]
            bits = np.unpackbits(np.frombuffer(f["payload"], np.uint8), count=sum(sizes)).astype(bool)
            for k, own in zip(at, np.split(bits, np.cumsum(sizes)[:-1])):
                if again[k] is None:
                    again[k] = own
        first = np.concatenate([s.first for s in self.found])
        hits = [f + np.flatnonzero(again[k]) for f, k in zip(first.tolist(), self.of.tolist()) if again[k] is not None]
        return np.sort(np.concatenate([np.zeros(0, np.int64), *hits]))


def _codec():
    return pa.Codec("zstd", compression_level=1)


def _pieces_in(payload: bytes):
    """(texts, residues, inner, keys) of a payload."""
    raw = memoryview(_codec().decompress(payload[8:], int.from_bytes(payload[:8], "little"), asbytes=True))
    m = int.from_bytes(raw[:4], "little")
    size, at = np.frombuffer(raw, "<u4", m, 4), 4 + 4 * m
    residue, inner = np.frombuffer(raw, np.uint8, m, at), np.frombuffer(raw, np.uint8, m, at + m)
    key, at = np.frombuffer(raw, "<u8", m, at + 2 * m), at + 10 * m
    ends = at + np.cumsum(size.astype(np.int64))
    return [bytes(raw[e - n : e]) for e, n in zip(ends.tolist(), size.tolist())], residue, inner, key


def piece_answers(c: Cover, payloads: list[bytes]) -> list[bytes]:
    """For each start of each piece of each blob a bit: does its string occur again in the bucket?"""
    blobs = [_pieces_in(p) for p in payloads]
    texts = [t for blob in blobs for t in blob[0]]
    residue, inner, key = (np.concatenate([blob[k] for blob in blobs]) for k in (1, 2, 3))
    number: dict[bytes, int] = {}
    of = np.array([number.setdefault(t, len(number)) for t in texts], np.int64)
    distinct, times = list(number), np.bincount(of, minlength=len(number))
    _, at = np.unique(of, return_index=True)
    key, residue, inner = key[at], residue[at], inner[at]
    again: list = [None] * len(distinct)
    # Only keys with several pieces, or one that may repeat itself, have something to sort.
    order = np.argsort(key, kind="stable")
    head = np.flatnonzero(np.append(True, key[order[1:]] != key[order[:-1]]))
    held, size = [], 0

    def sort():
        for k, found in zip(held, repeated_starts(c, [distinct[k] for k in held], residue[held])):
            again[k] = found

    for a, b in zip(head.tolist(), np.append(head[1:], len(order)).tolist()):
        own = order[a:b]
        if b - a == 1 and not (inner[own[0]] and times[own[0]] == 1):
            continue
        held += own.tolist()
        size += sum(len(distinct[k]) - c.n + 1 for k in own)
        if size >= SORT_STARTS:
            sort()
            held, size = [], 0
    if held:
        sort()
    out, i = [], 0
    for blob in blobs:
        bits = []
        for t in blob[0]:
            k, i = of[i], i + 1
            starts = len(t) - c.n + 1
            bits.append(np.ones(starts, bool) if times[k] > 1 else again[k] if again[k] is not None else np.zeros(starts, bool))
        out.append(np.packbits(np.concatenate(bits)).tobytes())
    return out


def repeated_strings(docs: DataFrame, min_length: int = 200, text_col: str = "text") -> DataFrame:
    """digest (md5, hex), n_removed, n_spans, kept_sha256 and spans (byte ranges removed) of
    every distinct text from which something goes."""
    require(docs, text_col)
    spark = docs.sparkSession
    small_batches(spark)
    c = Cover(min_length)
    width = max(4, shuffle_width(spark))
    name = f"text_blocks_{uuid.uuid4().hex}"
    blocks = text_blocks(docs, text_col, min_length, name, width)
    try:
        n_bytes = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
        buckets = max(width, -(-n_bytes // BUCKET_BYTES))
        rows = blocks.select("block", "row", "lengths", "data")

        def with_flags(frame, flags, name):
            """``frame`` with the flags of its rows; the join is by block alone, as the table is bucketed by it."""
            flags = flags.select(F.col("block").alias("b"), F.col("row").alias("r"), F.col("flags").alias(name))
            own = (F.col("block") == F.col("b")) & (F.col("row") - F.col("r") == 0)
            return frame.join(flags.hint("shuffle_hash"), own, "left").drop("b", "r")

        def view(batch, i):
            lengths = np.frombuffer(batch.column(2)[i].as_py(), np.int64)
            return batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), lengths, np.frombuffer(batch.column(3)[i].as_buffer(), np.uint8)

        def each(f):
            def run(batches):
                for batch in batches:
                    for i in range(batch.num_rows):
                        yield from f(*view(batch, i), *(batch.column(k)[i].as_py() for k in range(4, batch.num_columns)))

            return run

        def keys(block, row, lengths, data):
            yield blob_batch(block, row, *key_payloads(Segments(c, data, lengths), buckets))

        told = answered(rows.mapInArrow(each(keys), BLOB), buckets, lambda p: key_answers(p, HEAVY))
        cut_any = bool(told.where(F.contains("payload", F.lit(bytes([CUT])))).limit(1).count())
        rows = with_flags(rows, by_row(told, width), "told")
        if cut_any:

            def cut_keys(block, row, lengths, data, told):
                yield blob_batch(block, row, *key_payloads(candidates(c, lengths, data, buckets, told, None)[1], buckets))

            told_cut = answered(rows.mapInArrow(each(cut_keys), BLOB), buckets, lambda p: key_answers(p, 1 << 62))
            rows = with_flags(rows, by_row(told_cut, width), "told_cut")
        else:
            rows = rows.withColumn("told_cut", F.lit(None).cast("array<struct<bucket:int,payload:binary>>"))

        def pieces(block, row, lengths, data, told, told_cut):
            own = Pieces(list(candidates(c, lengths, data, buckets, told, told_cut or [])), buckets)
            yield blob_batch(block, row, own.used, own.payloads())

        found = answered(rows.mapInArrow(each(pieces), BLOB), buckets, lambda p: piece_answers(c, p))

        def removed(block, row, lengths, data, told, told_cut, found, digests, copied):
            own = Pieces(list(candidates(c, lengths, data, buckets, told, told_cut or [])), buckets)
            yield from removals(c.n, data, lengths, own.starts(found), digests, copied)

        rows = with_flags(rows, by_row(found, width), "found")
        whole = blocks.select(F.col("block").alias("wb"), F.col("row").alias("wr"), "digests", "copied")
        rows = rows.join(whole.hint("shuffle_hash"), (F.col("block") == F.col("wb")) & (F.col("row") - F.col("wr") == 0))
        rows = rows.select("block", "row", "lengths", "data", "told", "told_cut", "found", "digests", "copied")
        return checkpointed(rows.mapInArrow(each(removed), "digest string, n_removed long, n_spans long, kept_sha256 string, spans array<long>"))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def removals(n: int, data, lengths, hits, digests, copied):
    """What goes from each text of a row, by the places where repeated strings start."""
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    cut = np.searchsorted(hits, bounds)
    out = []
    for d in np.flatnonzero((np.diff(cut) > 0) | (np.frombuffer(copied, np.uint8) > 0)).tolist():
        a, b = int(bounds[d]), int(bounds[d + 1])
        own = hits[cut[d] : cut[d + 1]] - a
        edge = np.bincount(own, minlength=b - a + 1) - np.bincount(own + n, minlength=b - a + 1)
        gone = np.ones(b - a, bool) if copied[d] else np.cumsum(edge)[:-1] > 0
        turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        kept = hashlib.sha256(data[a:b][~gone].tobytes()).hexdigest()
        out.append((digests[16 * d : 16 * d + 16].hex(), int(gone.sum()), len(turns) // 2, kept, turns.tolist()))
    if out:
        columns = list(zip(*out))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["digest", "n_removed", "n_spans", "kept_sha256", "spans"])


def deduplicated(docs: DataFrame, min_length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of every row."""
    require(docs, id_col, text_col)
    found = repeated_strings(docs, min_length, text_col).withColumnRenamed("kept_sha256", "cut_sha256").withColumnRenamed("digest", "f_digest")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), F.md5(raw).alias("digest"), F.sha2(raw, 256).alias("whole_sha256"))
    out = slim.join(found, F.col("digest") == F.col("f_digest"), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<long>")).alias("spans"))

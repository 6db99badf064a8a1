"""Vectorised byte-level text kernels: words, lines, hashes and identities over Arrow buffers.

All kernels see the whole UTF-8 text of each document. Documents are taken in
chunks of bounded bytes, so the working set stays small whatever a batch holds;
one document is never cut, so the longest document bounds a chunk from below: the
working arrays take some tens of bytes for each of its bytes.

Two byte ranges are taken for equal by their ``identities`` alone; the plain 64-bit
hashes only choose features and places.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[32, 9, 10, 11, 12, 13]] = False

ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[48:58] = True
ALNUM_WORD[97:123] = True
ALNUM_WORD[128:] = True

_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random odd 64-bit code for every byte value.
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_table(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = BASE if kind == "up" else BASE_INVERSE
        full = np.full(max(n, CHUNK_BYTES + 2), step, np.uint64)
        full[0] = 1
        _powers[kind] = np.cumprod(full, dtype=np.uint64)
    return _powers[kind][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all bits."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def as_binary(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    return column


def chunks(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; null rows are empty."""
    column = as_binary(column)
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


class Words:
    """Words of the documents of one chunk.

    ``starts``/``ends`` are byte positions, ``bounds[d]:bounds[d + 1]`` the words of document d.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = table[data]
        firsts = offsets[:-1][np.diff(offsets) > 0]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[firsts] = False
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        lasts = offsets[1:][np.diff(offsets) > 0] - 1
        after[lasts] = False
        self.inside = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``segment_hash`` takes the hash of any byte range."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODE[data] * _power_table("up", len(data)), out=out[1:], dtype=np.uint64)
    return out


def segment_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    down = _power_table("down", len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


#: Low bytes kept of a lane for 0 to 8 bytes.
_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Ranges of up to so many bytes are their own identity.
SHORT = 15
_KEY = b"identity of a byte range"


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one little-endian integer; zeros follow the end."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))


def identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits (a, b) for each byte range, equal if and only if the bytes are.

    Up to SHORT bytes are held as they are, with their number in the top byte; a longer
    range has 120 bits of a keyed BLAKE2 digest and 255 in the top byte."""
    n = ends - starts
    lane = lanes(data)
    a = lane[starts] & _KEPT[np.minimum(n, 8)]
    b = lane[np.minimum(starts + 8, len(data) + 8)] & _KEPT[np.clip(n - 8, 0, 7)]
    b |= n.astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(n > SHORT)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        digests = b"".join([blake2b(raw[s:e], digest_size=16, key=_KEY).digest() for s, e in zip(starts[long].tolist(), ends[long].tolist())])
        pair = np.frombuffer(digests, "<u8").reshape(-1, 2)
        a[long], b[long] = pair[:, 0], pair[:, 1] | (np.uint64(255) << np.uint64(56))
    return a, b


def identity_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a + mix(b) * BASE)


def grouped(h: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, new): the rows sorted by hash, rows with equal columns next to each other and
    in their old order; ``new`` marks the first of each distinct row. The hash follows from
    the columns and need not tell all of them apart."""
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    differs = np.zeros(len(h), bool)
    for c in columns:
        differs[1:] |= c[order[1:]] != c[order[:-1]]
    if (differs & ~new).any():  # one hash, several values
        order = np.lexsort((*columns, h))
        for c in (h, *columns):
            new[1:] |= c[order[1:]] != c[order[:-1]]
    return order, new


def labels(h: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """A number for each row, the same for rows with equal columns."""
    order, new = grouped(h, *columns)
    out = np.empty(len(h), np.int64)
    out[order] = np.cumsum(new)
    return out


def run_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """``segment_hash`` of the n bytes from each place on."""
    prefix, m = prefix_hash(data), len(data) - n + 1
    return mix((prefix[n:] - prefix[:m]) * _power_table("down", m))


def window_hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive codes (len(codes) - n + 1 of them)."""
    m = len(codes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out *= BASE
        out += codes[k : k + m]
    return mix(out)


def per_doc(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values over each document's range."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]

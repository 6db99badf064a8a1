"""Edit-aware token counts: a segment tree of pre-tokens for every document.

A byte-level BPE encodes each pre-token by itself, so a text's count is the sum over
its pre-tokens. The tree's leaves hold runs of pre-tokens (their lengths in characters
and in tokens), inner nodes the sums below. An edit finds its place by descending along
the characters, cuts the text again from a pre-token that ends at least CONTEXT
characters before it, and stops as soon as a cut behind the edit falls on an old one:
from there on the old pre-tokens hold, as the pattern looks only forward. Only the
pre-tokens between are encoded, and only the sums on the paths of the touched leaves
change.

Edits are (start, end, replacement) in characters of the text as it was, in ascending
order and disjoint. Edge cases: null and empty texts have no pre-tokens; an edit beyond
the end or out of order raises an error; no edits (null or empty) leave a tree as it is;
repeated rows have trees of their own; an empty table gives an empty result; a long text
is one tree, whose arrays take some tens of bytes for each of its pre-tokens.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .common import require, small_batches

LEAF = 64
#: The one pattern known here (a fixed value of its rank files). No alternative of it looks
#: more than two characters past its end, so pre-tokens that end CONTEXT characters before
#: an edit stay. Nothing is known of another pattern: its edits cut the text from its start.
KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTEXT = 3
MAX_CACHED = 60_000


class Counter:
    """Tokens of a pre-token under a tiktoken rank file, with a bounded cache."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.context = CONTEXT if pattern == KNOWN else None
        self.core = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.known: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= MAX_CACHED:
                self.known.clear()
            n = self.known[piece] = len(self.core.encode_single_piece(piece.encode()))
        return n


_counters: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    if (path, pattern) not in _counters:
        _counters[path, pattern] = Counter(path, pattern)
    return _counters[path, pattern]


class TokenTree:
    """Segment tree over leaves of pre-tokens; ``nodes[1]`` is the root, (characters, tokens)."""

    def __init__(self, text: str, lengths: np.ndarray, counts: np.ndarray, sizes: np.ndarray, nodes: np.ndarray):
        self.text, self.lengths, self.counts, self.nodes = text, lengths, counts, nodes
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.width = len(nodes) // 2
        self.changed: dict[int, tuple[list[int], list[int]]] = {}

    @classmethod
    def build(cls, text: str, coder: Counter) -> TokenTree:
        pieces = coder.pattern.findall(text)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        counts = np.fromiter(map(coder.count, pieces), np.int64, len(pieces))
        n = max(1, -(-len(pieces) // LEAF))
        sizes = np.full(n, LEAF)
        sizes[-1] = len(pieces) - LEAF * (n - 1)
        width = 1 << (n - 1).bit_length()
        nodes = np.zeros((2 * width, 2), np.int64)
        if len(pieces):
            cut = np.arange(n) * LEAF
            nodes[width : width + n, 0] = np.add.reduceat(lengths, cut)
            nodes[width : width + n, 1] = np.add.reduceat(counts, cut)
        low = width
        while low > 1:
            nodes[low // 2 : low] = nodes[low : 2 * low : 2] + nodes[low + 1 : 2 * low : 2]
            low //= 2
        return cls(text, lengths, counts, sizes, nodes)

    @property
    def tokens(self) -> int:
        return int(self.nodes[1, 1])

    def leaf(self, i: int) -> tuple[list[int], list[int]]:
        if i in self.changed:
            return self.changed[i]
        if i + 1 >= len(self.starts):
            return [], []
        a, b = self.starts[i], self.starts[i + 1]
        return self.lengths[a:b].tolist(), self.counts[a:b].tolist()

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds the character."""
        node, first = 1, 0
        while node < self.width:
            node *= 2
            left = int(self.nodes[node, 0])
            if at >= first + left:
                node, first = node + 1, first + left
        return node - self.width, first

    def store(self, i: int, lengths: list[int], counts: list[int]) -> None:
        self.changed[i] = (lengths, counts)
        node = self.width + i
        delta = np.array([sum(lengths), sum(counts)]) - self.nodes[node]
        while node:
            self.nodes[node] += delta
            node //= 2

    def edit(self, start: int, end: int, replacement: str, coder: Counter) -> int:
        """Apply one edit in characters of the text as it is now; returns the pre-tokens encoded."""
        if not 0 <= start <= end <= len(self.text):
            raise ValueError(f"edit {start}:{end} is outside the text")
        text = self.text[:start] + replacement + self.text[end:]
        shift = len(text) - len(self.text)
        # From a pre-token's start at or before start - context on, everything may change.
        safe = 0 if coder.context is None else start - coder.context
        first_leaf, at = self.find(max(0, safe))
        lengths, counts = self.leaf(first_leaf)
        keep = 0
        while keep < len(lengths) and at + lengths[keep] <= safe:
            at += lengths[keep]
            keep += 1
        head = (lengths[:keep], counts[:keep])
        leaf, rest, place = first_leaf, (lengths[keep:], counts[keep:]), 0
        old, begin = at, at  # old: end of the old pre-tokens passed
        fresh: tuple[list[int], list[int]] = ([], [])
        for m in coder.pattern.finditer(text, begin):
            fresh[0].append(m.end() - m.start())
            fresh[1].append(coder.count(m[0]))
            now = m.end()
            if now < start + len(replacement):
                continue
            while old < now - shift:
                while place == len(rest[0]) and leaf + 1 < self.width:
                    self.store(leaf, [], [])
                    leaf, place = leaf + 1, 0
                    rest = self.leaf(leaf)
                if place == len(rest[0]):
                    break
                old += rest[0][place]
                place += 1
            if old == now - shift and old >= end:
                break
        else:  # the text ended first: no old pre-token is left
            while leaf + 1 < self.width:
                self.store(leaf, [], [])
                leaf += 1
            rest, place = self.leaf(leaf), len(self.leaf(leaf)[0])
            if leaf == first_leaf:
                place, rest = 0, ([], [])
        tail = (rest[0][place:], rest[1][place:])
        if leaf == first_leaf:
            self.store(leaf, head[0] + fresh[0] + tail[0], head[1] + fresh[1] + tail[1])
        else:
            self.store(first_leaf, head[0] + fresh[0], head[1] + fresh[1])
            self.store(leaf, *tail)
        self.text = text
        return len(fresh[0])

    def apply(self, edits, coder: Counter) -> int:
        """Apply edits given in characters of the text as it was; returns the pre-tokens encoded."""
        shift, last, encoded = 0, 0, 0
        for start, end, replacement in edits:
            if start < last:
                raise ValueError("edits overlap or are out of order")
            encoded += self.edit(start + shift, end + shift, replacement, coder)
            shift += len(replacement) - (end - start)
            last = end
        return encoded

    def columns(self) -> tuple:
        """(text, lengths, counts, sizes, nodes) to store; leaves that grew are cut anew."""
        if not self.changed:
            sizes = np.diff(self.starts)
            return self.text, self.lengths, self.counts, sizes, self.nodes
        leaves = [self.leaf(i) for i in range(self.width)]
        if max(len(x) for x, _ in leaves) > 4 * LEAF:  # keep descents short
            lengths, counts = (np.array([v for leaf in leaves for v in leaf[k]], np.int64) for k in (0, 1))
            whole = TokenTree.__new__(TokenTree)
            n = max(1, -(-len(lengths) // LEAF))
            sizes = np.full(n, LEAF)
            sizes[-1] = len(lengths) - LEAF * (n - 1)
            width = 1 << (n - 1).bit_length()
            nodes = np.zeros((2 * width, 2), np.int64)
            nodes[width : width + n] = np.stack([np.add.reduceat(x, np.arange(n) * LEAF) for x in (lengths, counts)], axis=1) if len(lengths) else 0
            while width > 1:
                nodes[width // 2 : width] = nodes[width : 2 * width : 2] + nodes[width + 1 : 2 * width : 2]
                width //= 2
            TokenTree.__init__(whole, self.text, lengths, counts, sizes, nodes)
            return whole.columns()
        sizes = np.array([len(x) for x, _ in leaves])
        return (self.text, *[np.array([v for leaf in leaves for v in leaf[k]], np.int64) for k in (0, 1)], sizes, self.nodes)


TREE = "text string, lengths binary, counts binary, sizes binary, nodes binary"
EDITS = "array<struct<start:int,end:int,text:string>>"


def _packed(columns: tuple) -> tuple:
    text, lengths, counts, sizes, nodes = columns
    return text, lengths.astype("<u4").tobytes(), counts.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), nodes.astype("<u4").tobytes()


def _tree(text, lengths, counts, sizes, nodes) -> TokenTree:
    a, b, c, d = (np.frombuffer(x, "<u4").astype(np.int64) for x in (lengths, counts, sizes, nodes))
    return TokenTree(text, a, b, c, d.reshape(-1, 2).copy())


def token_trees(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens and the stored tree (columns of TREE) of every row."""
    require(docs, id_col, text_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = counter(ranks, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                trees = [TokenTree.build(t or "", coder) for t in part.column(1).to_pylist()]
                columns = list(zip(*(_packed(t.columns()) for t in trees)))
                kinds = (pa.string(), *[pa.binary()] * 4)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.tokens for t in trees], pa.int64()), *map(pa.array, columns, kinds)], ["doc_id", "n_tokens", "text", "lengths", "counts", "sizes", "nodes"])

    return slim.mapInArrow(run, f"doc_id {kind}, n_tokens long, {TREE}")


def edited(trees: DataFrame, ranks: str, pattern: str, edits_col: str = "edits") -> DataFrame:
    """Trees after their edits (column of type EDITS): doc_id, n_before, n_tokens, n_edits,
    n_encoded (pre-tokens encoded for the edits) and the stored tree."""
    require(trees, "doc_id", "text", "lengths", "counts", "sizes", "nodes", edits_col)
    rows = trees.select("doc_id", "text", "lengths", "counts", "sizes", "nodes", edits_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = counter(ranks, pattern)
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                numbers, columns = [], []
                for *stored, edits in zip(*(c.to_pylist() for c in part.columns[1:])):
                    tree = _tree(*stored)
                    before = tree.tokens
                    edits = [(e["start"], e["end"], e["text"] or "") for e in edits or ()]
                    encoded = tree.apply(edits, coder)
                    numbers.append((before, tree.tokens, len(edits), encoded))
                    columns.append(_packed(tree.columns()))
                kinds = (*[pa.int64()] * 4, pa.string(), *[pa.binary()] * 4)
                values = [x + y for x, y in zip(numbers, columns)]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, zip(*values), kinds)], ["doc_id", "n_before", "n_tokens", "n_edits", "n_encoded", "text", "lengths", "counts", "sizes", "nodes"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_before long, n_tokens long, n_edits long, n_encoded long, {TREE}")


#: What ``redactions`` replaces: e-mail addresses and runs of digits such as phone numbers.
REDACTED = regex.compile(r"(?P<mail>[\w.+-]+@[\w-]+(?:\.[\w-]+)+)|(?P<number>\+?\d[\d ()/-]{5,}\d)")


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that put <email> and <number> for personal data and drop lines that repeat an earlier line."""
    out, seen, at = [], set(), 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip() and line in seen:
            out.append((at, min(end + 1, len(text)), ""))
        else:
            seen.add(line)
            if "@" in line or any(map(str.isdigit, line)):
                out += [(at + m.start(), at + m.end(), f"<{'email' if m['mail'] else 'number'}>") for m in REDACTED.finditer(line)]
        at = end + 1
    return out


def edited_counts(docs: DataFrame, ranks: str, pattern: str, edits_of, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``edited`` counts when ``edits_of`` (a function of the text) gives the edits of
    each tree of ``token_trees``: doc_id, n_before, n_tokens, n_edits, n_encoded. Trees are
    built, edited and read one after the other in one step and are not stored."""
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = counter(ranks, pattern)
        for batch in batches:
            numbers = []
            for text in batch.column(1):
                text = text.as_py() or ""
                tree, edits = TokenTree.build(text, coder), edits_of(text)
                before = tree.tokens
                encoded = tree.apply(edits, coder)
                numbers.append((before, tree.tokens, len(edits), encoded))
            columns = [pa.array(c, pa.int64()) for c in zip(*numbers)] if numbers else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_before", "n_tokens", "n_edits", "n_encoded"])

    return slim.mapInArrow(run, f"doc_id {kind}, n_before long, n_tokens long, n_edits long, n_encoded long")


def with_redactions(trees: DataFrame) -> DataFrame:
    """``trees`` with the edits of ``redactions`` for each text."""
    trees = trees.drop("edits")
    at = trees.columns.index("text")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))

    def run(batches):
        for batch in batches:
            edits = [[{"start": a, "end": b, "text": t} for a, b, t in redactions(x or "")] for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, kind)], [*batch.schema.names, "edits"])

    return trees.mapInArrow(run, StructType(list(trees.schema.fields)).add("edits", DataType.fromDDL(EDITS)))

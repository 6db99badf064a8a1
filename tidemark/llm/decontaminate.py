"""Benchmark decontamination with a distributed positional inverted index.

The index is a stored table, cut by document: each block holds the postings of some
documents, all positions of a term in one sorted list. A phrase is sought in every
block by its rarest term there: the list of that term, moved by the term's offset,
gives the candidate starts, and the lists of the other terms, rarest first, are
intersected with it. With ``slop`` 0 that is an exact phrase match. With a greater slop
(proximity match) a phrase matches at a start, from which it would fit into the
document, if each of its terms stands in the document at most that many words from its
place; the rarest term too may be off its place, so starts do not depend on the block.
Terms are held by their identities, so different words never match.

The phrases of a test set are its windows of ``window`` consecutive words; a shorter
item is one window. Items are held by all tasks at once only up to MAX_WORDS words;
beyond that the stored index is searched again for each share of the items.

Edge cases: null and empty texts have no words and no hits; items without words match
nothing; items that share an id count once; the windows of an item without an id hit
words, but it is not in the list of items; repeated rows each get their own result; an
empty test set gives no hits, an empty table an empty result; a long text is one block.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import checkpointed, delete_folder, require, shared_folder, small_batches

WINDOW = 10
MAX_WORDS = 1_000_000

INDEX_COLUMNS = "bounds binary, terms binary, heads binary, positions binary"


def word_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The term of every word (hash and identity, a row of three integers each), and each
    document's range of words."""
    w = tc.Words(tc.LOWER[data], offsets, tc.ALNUM_WORD)
    a, b = tc.identities(w.data, w.starts, w.ends)
    return np.stack([tc.identity_hash(a, b), a, b], axis=1), w.bounds


def block_lists(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, heads, positions) of the words of a block; terms are in order of their hash."""
    order, new = tc.grouped(*words.T)
    heads = np.flatnonzero(new)
    return words[order[heads]], np.append(heads, len(order)).astype(np.int64), order.astype(np.int32)


def slots(terms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted term among the terms, -1 where it is not there."""
    at = np.searchsorted(terms[:, 0], wanted[:, 0])
    todo = np.arange(len(wanted))
    out = np.full(len(wanted), -1, np.int64)
    while len(todo):
        todo = todo[at[todo] < len(terms)]
        todo = todo[terms[at[todo], 0] == wanted[todo, 0]]
        same = (terms[at[todo], 1:] == wanted[todo, 1:]).all(axis=1)
        out[todo[same]] = at[todo[same]]
        todo = todo[~same]
        at[todo] += 1
    return out


def positional_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a block: doc_ids, bounds (int64 word range of each document), terms (three
    uint64 each: hash and identity, in order of the hash), heads (int64 range of each
    term's list) and positions (int32, sorted in each list)."""
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in tc.chunks(batch.column(1)):
                words, bounds = word_terms(data, offsets)
                parts = (bounds.astype(np.int64), *block_lists(words))
                ids = batch.column(0).slice(first, end - first)
                lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([lists, *[pa.array([x.tobytes()], pa.binary()) for x in parts]], ["doc_ids", "bounds", "terms", "heads", "positions"])

    return slim.mapInArrow(run, f"doc_ids array<{kind}>, {INDEX_COLUMNS}")


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``positional_index`` stored as a table at ``path`` and read from there."""
    positional_index(docs, id_col, text_col).write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


class Phrases:
    """Windows of test items, as one table of words and their terms."""

    def __init__(self, items: list[tuple[str | None, str]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        texts = pa.array([text for _, text in items], pa.string())
        words, item, start, length = [np.zeros((0, 3), np.uint64)], [], [], []
        base = 0
        for first, _, data, offsets in tc.chunks(texts):
            found, bounds = word_terms(data, offsets)
            words.append(found)
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                n = min(window, b - a)
                for s in range(a, b - n + 1) if n else ():
                    item.append(first + i)
                    start.append(base + s)
                    length.append(n)
            base += len(found)
        words = np.concatenate(words)
        self.item, self.start, self.length = (np.array(x, np.int64) for x in (item, start, length))
        order, new = tc.grouped(*words.T)
        self.distinct, self.term = words[order[new]], tc.labels(*words.T) - 1
        at = self.start[:, None] + np.arange(window)
        self.used = np.arange(window) < self.length[:, None]
        self.at = np.where(self.used, at, 0)


def find(phrases: Phrases, bounds, terms, heads, positions, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(window, start) of all matches in one block."""
    none = np.zeros(0, np.int64)
    if not len(terms) or not len(phrases.item):
        return none, none
    slot = slots(terms, phrases.distinct)
    lengths = np.where(slot >= 0, np.diff(heads)[slot], 0)[phrases.term]
    cost = np.where(phrases.used, lengths[phrases.at], np.iinfo(np.int64).max)
    live = np.flatnonzero(cost.min(axis=1) > 0)
    if not len(live):
        return none, none
    order = np.argsort(cost[live], axis=1, kind="stable")
    lists = slot[phrases.term]
    total = int(heads[-1])
    stride = np.int64(total + 2 * slop + 2)
    keys = np.repeat(np.arange(len(terms)), np.diff(heads)) * stride + positions + slop  # sorted: all lists in one

    def part(k):
        return order[:, k], lists[phrases.at[live, order[:, k]]]

    offset, rarest = part(0)
    sizes = np.diff(heads)[rarest]
    row = np.repeat(np.arange(len(live)), sizes)
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = positions[heads[rarest][row] + inner].astype(np.int64)
    doc = np.searchsorted(bounds, place, "right")  # of the rarest term, so of the match
    start = place - offset[row]
    if slop:
        moves = np.arange(-slop, slop + 1)
        row, doc, start = np.repeat(row, len(moves)), np.repeat(doc, len(moves)), (start[:, None] + moves).ravel()
    inside = (start >= bounds[doc - 1]) & (start + phrases.length[live][row] <= bounds[doc])
    row, start, doc = row[inside], start[inside], doc[inside]
    if slop:
        _, once = np.unique(row * stride + start, return_index=True)
        row, start, doc = row[once], start[once], doc[once]
    for k in range(1, phrases.at.shape[1]):
        if not len(row):
            break
        offset, entry = part(k)
        used = k < phrases.length[live][row]
        place = start + offset[row]
        low = np.maximum(place - slop, bounds[doc - 1])
        high = np.minimum(place + slop, bounds[doc] - 1)
        at = np.searchsorted(keys, entry[row] * stride + low + slop)
        hit = keys[np.minimum(at, total - 1)] <= entry[row] * stride + high + slop
        stay = ~used | ((at < total) & hit)
        row, start, doc = row[stay], start[stay], doc[stay]
    return live[row], start


def usable_items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text IS NOT NULL")


def phrases_of(items: DataFrame, part: int, passes: int, window: int) -> Phrases:
    """The windows of one share of the items; its words are bounded by MAX_WORDS, about."""
    own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == part) if passes > 1 else items
    return Phrases(sorted(((r.item, r.text) for r in own.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1])), window)


def search(index: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit (words inside a match), items (sorted
    ids, as text, of items that match) and spans (word ranges [start, end) of the hits)."""
    require(items, item_col, text_col)
    spark = index.sparkSession
    small_batches(spark)
    tests = usable_items(items, item_col, text_col)
    words = F.regexp_count(F.lower("text"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
    count = tests.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0]
    passes = max(1, -(-count // MAX_WORDS))
    id_type = index.schema["doc_ids"].dataType.elementType.simpleString()
    if passes > 1:
        index = checkpointed(index.withColumn("block", F.monotonically_increasing_id()))
    else:
        index = index.withColumn("block", F.lit(0).cast("long"))
    index = index.select("doc_ids", "bounds", "terms", "heads", "positions", "block")

    def searched(part):
        phrases = spark.sparkContext.broadcast(phrases_of(tests, part, passes, window))

        def run(batches):
            ph = phrases.value
            for batch in batches:
                for i in range(batch.num_rows):
                    ids = batch.column(0)[i].values
                    views = [np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in ((1, np.int64), (2, np.uint64), (3, np.int64), (4, np.int32))]
                    views[1] = views[1].reshape(-1, 3)
                    yield block_result(ph, ids, batch.column(5)[i].as_py(), *views, slop=slop)

        schema = f"doc_id {id_type}, block long, place int, n_words long, n_hit long, items array<string>, spans array<long>"
        return index.mapInArrow(run, schema)

    found = searched(0)
    for part in range(1, passes):
        found = found.union(searched(part))
    if passes > 1:
        found = found.groupBy("block", "place").agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
            F.flatten(F.collect_list("spans")).alias("spans"),
        )
        found = merged_spans(found)
    return found.select("doc_id", "n_words", "n_hit", "items", "spans")


def block_result(ph: Phrases, ids, block, bounds, terms, heads, positions, slop=0) -> pa.RecordBatch:
    n = len(bounds) - 1
    which, start = find(ph, bounds, terms, heads, positions, slop)
    total = int(heads[-1]) if len(heads) else 0
    edge = np.bincount(start, minlength=total + 1) - np.bincount(start + ph.length[which], minlength=total + 1)
    inside = np.cumsum(edge)[:total] > 0
    n_hit = tc.per_doc(inside, bounds)
    items, spans = [[] for _ in range(n)], [[] for _ in range(n)]
    for d, i in np.unique(np.stack([np.searchsorted(bounds, start, "right") - 1, ph.item[which]], axis=1), axis=0).tolist() if len(which) else ():
        items[d].append(ph.names[i])
    for d in np.flatnonzero(n_hit).tolist():
        flags = np.concatenate([[False], inside[bounds[d] : bounds[d + 1]], [False]])
        spans[d] = np.flatnonzero(flags[1:] != flags[:-1]).tolist()
    columns = [ids, pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), pa.array(np.diff(bounds)), pa.array(n_hit), pa.array([sorted({*x} - {None}) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "block", "place", "n_words", "n_hit", "items", "spans"])


def merged_spans(found: DataFrame) -> DataFrame:
    """Spans of several searches of a document made disjoint, and n_hit counted from them."""
    first = found.select("doc_id", "n_words", "items", "spans")

    def run(batches):
        for batch in batches:
            spans, hits = [], []
            for flat in batch.column(3).to_pylist():
                out: list[int] = []
                for a, b in sorted(zip(flat[::2], flat[1::2])):
                    if out and a <= out[-1]:
                        out[-1] = max(out[-1], b)
                    else:
                        out += [a, b]
                spans.append(out)
                hits.append(sum(out[1::2]) - sum(out[::2]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.int64()), batch.column(2), pa.array(spans, pa.list_(pa.int64()))], ["doc_id", "n_words", "n_hit", "items", "spans"])

    kind = first.schema["doc_id"].dataType.simpleString()
    return first.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<long>")


def without_matches(docs: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of an item occurs, with all their columns.

    Blocks are indexed and searched where the rows are, so texts do not move. Items of
    more than MAX_WORDS words are searched in shares, one after the other."""
    require(docs, text_col)
    require(items, item_col, text_col)
    spark = docs.sparkSession
    small_batches(spark)
    tests = usable_items(items, item_col, text_col)
    count = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-count // (4 * MAX_WORDS)))
    at = docs.columns.index(text_col)

    def share(part, docs):
        phrases = spark.sparkContext.broadcast(phrases_of(tests, part, passes, window))

        def run(batches):
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, end, data, offsets in tc.chunks(batch.column(at)):
                    words, bounds = word_terms(data, offsets)
                    _, start = find(phrases.value, bounds, *block_lists(words))
                    clean[first + np.searchsorted(bounds, start, "right") - 1] = False
                yield batch.filter(pa.array(clean))

        return docs.mapInArrow(run, docs.schema)

    for part in range(passes):
        docs = share(part, docs)
    return docs


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """``search`` of an index of ``docs`` that is stored for it in the shared folder and deleted after it."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    try:
        index = write_index(docs, path, id_col, text_col)
        return checkpointed(search(index, items, item_col, text_col, window, slop))
    finally:
        delete_folder(spark, path)

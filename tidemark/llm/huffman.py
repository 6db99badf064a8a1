"""Token ids in a binary format: canonical length-limited Huffman coding.

A store is a folder of two Parquet tables, so that any store Spark reaches will do and
lost tasks are run again by Spark's own commit protocol.

  codebook   one row: max_bits int, lengths binary (uint8 code length of every id; 0: unused)
  blocks     part int, start long    order of the blocks; ids of the part before the block
             doc_ids array           documents of the block, in order
             lengths binary          int64 ids of each document
             n_tokens long
             bits binary             code words, first bit first, in big-endian 64-bit words
             checkpoints binary      int64 bit offset of every CHECKPOINT-th id

Code lengths come from the global counts by package-merge, codes are canonical (by
length, then id). A block is decoded without any other; inside it the stretches
between checkpoints are decoded side by side with a table of 2 ** max_bits entries.

Edge cases: null and empty texts hold the end id alone; a null doc_id comes first;
rows with one doc_id are ordered by their ids' hash, and may fall into several tasks; an
empty table gives an empty store; a single used id gets a code of one bit; a long text
is one row and one block, whole.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textcore as tc
from .common import delete_folder, require, shared_folder, shuffle_width, small_batches
from .tokens import encoder

MAX_BITS = 18
BLOCK_TOKENS = 1 << 17
CHECKPOINT = 128
#: Ids coded at once, for the caches, and ids that a task puts in order, about.
STRETCH, TASK_TOKENS = 1 << 14, 1 << 24


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """uint8 optimal code lengths of at most max_bits by package-merge."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids do not fit codes of {max_bits} bits")
    if n == 1:
        out[used] = 1
    if n < 2:
        return out
    order = used[np.lexsort((used, counts[used]))]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(max_bits):
        merged = np.concatenate([leaves, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1::2]
    take = 2 * n - 2
    lengths = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        chosen = int(np.count_nonzero(is_leaf[:take]))
        lengths[:chosen] += 1
        take = 2 * (take - chosen)
    out[order] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """uint64 code of every id; shorter codes first, then smaller ids."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    if len(order):
        top = int(lengths.max())
        step = np.left_shift(np.uint64(1), (top - lengths[order]).astype(np.uint64))
        first = np.cumsum(step) - step
        codes[order] = first >> (top - lengths[order]).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray, max_bits: int) -> np.ndarray:
    """32 * id + code length (at most 31 bits, ids below 2 ** 27) for each value of the next max_bits bits."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = np.left_shift(1, max_bits - lengths[order].astype(np.int64))
    out = np.ones(1 << max_bits, np.uint32)
    out[: int(span.sum())] = np.repeat((order * 32 + lengths[order]).astype(np.uint32), span)
    return out


def encode_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bytes]:
    """(bits, checkpoints) of a block's ids; the work goes in stretches that fit a cache."""
    step = STRETCH
    pieces, marks, base = [], [], 0
    for i in range(0, len(ids), step):
        part = ids[i : i + step]
        n = lengths[part].astype(np.int64)
        at = np.cumsum(n)
        stop = int(at[-1])
        at -= n
        marks.append(base + at[::CHECKPOINT])
        at += base & 63
        word, shift = at >> 6, 64 - (at & 63) - n
        words = np.zeros((stop + (base & 63)) // 64 + 2, np.uint64)
        code = codes[part]
        whole = (code << np.maximum(shift, 0).astype(np.uint64)) >> np.maximum(-shift, 0).astype(np.uint64)
        head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[head]] = np.add.reduceat(whole, head)
        over = np.flatnonzero(shift < 0)
        words[word[over] + 1] |= code[over] << (64 + shift[over]).astype(np.uint64)
        if pieces and base & 63:
            words[0] |= pieces.pop()[0]
        base += stop
        full = (stop + ((base - stop) & 63)) // 64
        pieces += [words[:full], words[full : full + 1]] if base & 63 else [words[:full]]
    out = np.concatenate([np.zeros(0, np.uint64), *pieces]).astype(">u8").tobytes()
    return out, np.concatenate([np.zeros(0, np.int64), *marks]).tobytes()


def decode_bits(bits: bytes, checkpoints: bytes, n_tokens: int, table: np.ndarray, max_bits: int) -> np.ndarray:
    at = np.frombuffer(checkpoints, np.int64).copy()
    words = np.concatenate([np.frombuffer(bits, ">u8").astype(np.uint64), np.zeros(CHECKPOINT * max_bits // 64 + 2, np.uint64)])
    out = np.empty((CHECKPOINT, len(at)), np.uint32)
    down = np.uint64(64 - max_bits)
    for k in range(min(CHECKPOINT, n_tokens)):
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        view = (words[word] << bit) | ((words[word + 1] >> np.uint64(1)) >> (np.uint64(63) - bit))
        entry = (view >> down).astype(np.int64)
        found = table[entry]
        out[k] = found >> np.uint32(5)
        at += found & np.uint32(31)
    return out.T.ravel()[:n_tokens]


def token_rows(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document, made where the document is: doc_id, part and row (where it was
    made), n_tokens and ids (little-endian uint32, or uint16 where they fit)."""
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        coder = encoder(tokenizer)
        width = np.dtype("<u2" if max(coder.vocabulary, end_id + 1) <= 1 << 16 else "<u4")
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, end, data, offsets in tc.chunks(batch.column(1)):
                ids, n = coder.encode(data, offsets, end_id)
                rows = end - first
                upto = np.concatenate([[0], np.cumsum(n)]) * width.itemsize
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(upto.astype(np.int64)), pa.py_buffer(ids.astype(width))])
                columns = [batch.column(0).slice(first, rows), pa.array(np.full(rows, part, np.int32)), pa.array(np.arange(row, row + rows)), pa.array(n), texts.cast(pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "row", "n_tokens", "ids"])
                row += rows

    return slim.mapInArrow(run, f"doc_id {kind}, part int, row long, n_tokens long, ids binary")


def ids_of(column: pa.Array, n: np.ndarray) -> np.ndarray:
    """All ids of a column of ``token_rows``, one after the other."""
    column = tc.as_binary(column)
    cut = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[cut[0] : cut[-1]] if cut[-1] > cut[0] else np.zeros(0, np.uint8)
    return raw.view("<u2" if len(raw) == 2 * int(n.sum()) else "<u4")


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> None:
    """Tokenize and write a store at ``path``. The ids are computed once, kept in a
    table beside the store until they are coded, and then deleted; texts do not move."""
    spark = docs.sparkSession
    kept = f"{path}-ids"
    token_rows(docs, tokenizer, end_id, id_col, text_col).write.option("compression", "zstd").parquet(kept)
    rows = spark.read.parquet(kept)

    def count(batches):
        total = np.zeros(1, np.int64)
        for batch in batches:
            found = np.bincount(ids_of(batch.column(0), batch.column(1).to_numpy()))
            if len(found) > len(total):
                total, found = found, total
            total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    counted = rows.select("ids", "n_tokens").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in counted), default=0) + 1, np.int64)  # at most one row an id of the vocabulary
    for r in counted:
        counts[r.id] = r.n
    lengths = code_lengths(counts, max_bits)
    spark.createDataFrame([(max_bits, bytearray(lengths.tobytes()))], "max_bits int, lengths binary").coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))
    # Rows of one id are told apart by where they were made, so a frequent id is spread too.
    parts = max(shuffle_width(spark), -(-int(counts.sum()) // TASK_TOKENS))
    order = ("doc_id", F.xxhash64("ids"), "part", "row")
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids")

    def encode(batches):
        lengths, codes = shared.value
        part, start, pending, held = TaskContext.get().partitionId(), 0, [], 0

        def block():
            names, each, flat = zip(*pending)
            names, n = pa.concat_arrays(names), np.concatenate(each)
            lists = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names)
            bits, marks = encode_bits(np.concatenate(flat), lengths, codes)
            values = ((n.tobytes(), pa.binary()), (held, pa.int64()), (bits, pa.binary()), (marks, pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([start], pa.int64()), lists, *[pa.array([v], t) for v, t in values]], ["part", "start", "doc_ids", "lengths", "n_tokens", "bits", "checkpoints"])

        for batch in batches:
            n = batch.column(1).to_numpy()
            ids = ids_of(batch.column(2), n)
            upto = np.concatenate([[0], np.cumsum(n)])
            first = 0
            while first < len(n):
                room = BLOCK_TOKENS - held
                end = max(first + 1, int(np.searchsorted(upto, upto[first] + room, "right")) - 1)
                pending.append((batch.column(0).slice(first, end - first), n[first:end], ids[upto[first] : upto[end]].copy()))
                held += int(upto[end] - upto[first])
                if held >= BLOCK_TOKENS or end < len(n):
                    yield block()
                    start, pending, held = start + held, [], 0
                first = end
        if pending:
            yield block()

    kind = rows.schema["doc_id"].dataType.simpleString()
    coded = placed.mapInArrow(encode, f"part int, start long, doc_ids array<{kind}>, lengths binary, n_tokens long, bits binary, checkpoints binary")
    coded.write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    delete_folder(spark, kept)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (little-endian uint32) of every document."""
    book = spark.read.parquet(f"{path}/codebook").first()
    max_bits, lengths = book.max_bits, np.frombuffer(bytes(book.lengths), np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r.part)  # a row a task that wrote
    before, at = {}, 0
    for r in parts:
        before[r.part] = at
        at += r.n
    shared = spark.sparkContext.broadcast((lengths, before))

    def decode(batches):
        lengths, before = shared.value
        table = decode_table(lengths, max_bits)
        for batch in batches:
            for i in range(batch.num_rows):
                part, start, n_tokens = (batch.column(c)[i].as_py() for c in (0, 1, 4))
                n = np.frombuffer(batch.column(3)[i].as_py(), np.int64)
                ids = decode_bits(batch.column(5)[i].as_py(), batch.column(6)[i].as_py(), n_tokens, table, max_bits)
                raw = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(n)
                each = [raw[4 * (e - k) : 4 * e] for e, k in zip(ends.tolist(), n.tolist())]
                columns = [batch.column(2)[i].values, pa.array(before[part] + start + ends - n), pa.array(n), pa.array(each, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    plain = blocks.select("part", "start", "doc_ids", "lengths", "n_tokens", "bits", "checkpoints")
    return plain.mapInArrow(decode, f"doc_id {kind}, start long, n_tokens long, ids binary")


def new_store_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"

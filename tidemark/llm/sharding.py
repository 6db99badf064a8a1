"""Sharding by vector bin packing.

Rows with equal texts form a group. Each group has a vector (bytes, tokens, rows);
groups go, largest first, to the shard where the dot product of the vector with the
shard's residual capacity is highest among those that have room. Groups with a
noticeable share of any total are placed so on the driver. All others are dealt by a
hash of their text to a fixed number of buckets; in each bucket every group is placed
by the same rule in bins of its own, one a shard, and the bins, whose number does not
depend on the input, are then placed with the large groups.

The law is ``bytes``: the shards' sizes are near equal. A group stays whole in one
shard unless its bytes alone are more than an equal share of all bytes; no law on
bytes could hold with it whole, so it is cut by row into the fewest equal pieces that
are not above that share. A group with many rows or tokens but few bytes is not cut.

Slots number the rows of a shard without gaps; they come from counts of sub-buckets of
the rows' places in the input, so no task sorts a whole shard, and a group, an id or a
null id that very many rows have is spread like any other rows.

Edge cases: null texts count as empty (size 1) and are in one group with empty ones; an
empty table gives an empty result; repeated rows are separate rows of the same group;
ties in the packing go to the lowest shard; a long text is one row like any other.
Results agree when the same files are read in the same splits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import checkpointed, require, shuffle_width, small_batches, word_count

BUCKETS = 4096
#: A group with over 1 / OWN_UNIT of the bytes, tokens or rows is placed by itself: at most 3 * OWN_UNIT groups.
OWN_UNIT = 2048
SUB_BUCKETS = 512
#: Slices of a piece of a group that is cut; pieces are runs of slices with near equal numbers of rows.
SLICES = 64


def pack(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unit; rows of ``vectors`` are (bytes, tokens, rows).

    A dimension in which a shard is above its capacity counts as full, so a unit of very
    many rows does not keep the bytes of others away from its shard."""
    n = len(vectors)
    placed = np.zeros(n, np.int64)
    if not n:
        return placed
    totals = vectors.sum(axis=0, dtype=np.float64)
    shares = vectors / np.where(totals > 0, totals, 1) * shards
    residual = np.ones((shards, shares.shape[1]))
    for i in np.lexsort((np.arange(n), -shares.max(axis=1))):
        v = shares[i]
        fits = (residual >= v - 1e-12).all(axis=1)
        score = np.maximum(residual, 0) @ v
        if not fits.any():  # the law's own dimension comes first
            fits = residual[:, 0] >= v[0] - 1e-12
        if fits.any():
            score = np.where(fits, score, -np.inf)
        else:
            score = residual[:, 0]
        best = int(np.argmax(score))
        residual[best] -= v
        placed[i] = best
    return placed


def binned(groups: DataFrame, shards: int) -> DataFrame:
    """digest, unit ("bucket bin") and the measures of every group of ``groups`` (digest,
    bytes, tokens, rows), each placed in one of its bucket's bins."""
    bucket = F.pmod(F.xxhash64(F.lit("bucket"), F.col("digest")), F.lit(BUCKETS)).cast("int")
    rows = groups.select(bucket.alias("bucket"), "digest", "bytes", "tokens", "rows")
    rows = rows.repartition(shuffle_width(groups.sparkSession), "bucket").sortWithinPartitions("bucket", "digest")

    def placed(batch):
        vectors = np.stack([batch.column(c).to_numpy() for c in (2, 3, 4)], axis=1).astype(np.float64)
        bucket = batch.column(0)[0].as_py()
        units = pa.array([f"{bucket} {b}" for b in pack(vectors, shards)], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(1), units, *batch.columns[2:]], ["digest", "unit", "bytes", "tokens", "rows"])

    def run(batches):
        held = []  # of the last bucket, still open
        for batch in batches:
            held.append(batch)
            whole = pa.Table.from_batches(held).combine_chunks()
            number = whole.column(0).to_numpy()
            heads = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else []
            for a, b in zip(heads[:-1], heads[1:]):
                yield placed(whole.slice(a, b - a).to_batches()[0])
            held = whole.slice(heads[-1]).to_batches() if len(heads) else []
        if held:
            yield placed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return rows.mapInArrow(run, "digest string, unit string, bytes long, tokens long, rows long")


def sharded(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and tokens of every row.

    The driver sees at most 3 * OWN_UNIT large groups, 2 * shards * SLICES slices,
    BUCKETS * shards bins and shards * SUB_BUCKETS counts, whatever the input's size."""
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = text.cast("binary")
    slim = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        word_count(text).alias("tokens"),
        F.crc32(raw).alias("text_crc32"),
        F.md5(raw).alias("digest"),
        F.xxhash64(F.monotonically_increasing_id()).alias("place"),
    )
    slim = checkpointed(slim)
    spark = slim.sparkSession

    measures = (F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    groups = checkpointed(slim.groupBy("digest").agg(*measures))
    names = ("bytes", "tokens", "rows")
    total = [float(x or 0) or 1.0 for x in groups.agg(*[F.sum(c) for c in names]).first()]
    noticeable = F.greatest(*[F.col(c) / F.lit(t) for c, t in zip(names, total)]) > 1.0 / OWN_UNIT
    units, vectors, cut = [], [], []  # the names of units that are placed together, and their measures
    for r in sorted(groups.where(noticeable).collect()):
        pieces = max(1, -(-int(r.bytes) * shards // int(total[0])))
        cut.append((r.digest, 1 if pieces == 1 else SLICES * pieces))
        if pieces == 1:
            units.append([f"{r.digest} 0"])
            vectors.append([r.bytes, r.tokens, r.rows])
    # Large groups go by a broadcast of their names, so that none meets in one task; all others by their digest.
    names_of_large = F.broadcast(spark.createDataFrame(cut, "o_digest string, slices int"))
    large = F.col("digest") == F.col("o_digest")
    slice_ = F.pmod(F.xxhash64(F.lit("slice"), F.col("place")), F.col("slices"))
    of_large = slim.join(names_of_large, large).select(*slim.columns, "slices", F.concat_ws(" ", "digest", slice_).alias("unit"))
    sliced = of_large.where("slices > 1").groupBy("digest", "slices", "unit").agg(*measures)
    found = sorted(sliced.collect(), key=lambda r: (r.digest, r.unit)) if any(n > 1 for _, n in cut) else []
    for digest in sorted({r.digest for r in found}):
        own = [r for r in found if r.digest == digest]
        pieces, rows = own[0].slices // SLICES, np.array([r.rows for r in own])
        piece = np.minimum((np.cumsum(rows) - rows) * pieces // rows.sum(), pieces - 1)
        for k in range(pieces):
            part = [r for r, at in zip(own, piece) if at == k]
            units.append([r.unit for r in part])
            vectors.append([sum(r[c] for r in part) for c in names])
    small = checkpointed(binned(groups.where(~noticeable), shards))
    for r in sorted(small.groupBy("unit").agg(*[F.sum(c).alias(c) for c in names]).collect()):
        units.append([r.unit])
        vectors.append([r.bytes, r.tokens, r.rows])
    shard_of = pack(np.array(vectors, np.float64).reshape(-1, 3), shards)
    places = spark.createDataFrame([(u, int(s)) for own, s in zip(units, shard_of) for u in own], "p_unit string, shard int")

    of_small = slim.join(names_of_large, large, "left_anti").join(small.select(F.col("digest").alias("g_digest"), "unit"), F.col("digest") == F.col("g_digest")).select(*slim.columns, "unit")
    placed = of_large.drop("slices").union(of_small).join(F.broadcast(places), F.col("unit") == F.col("p_unit"))
    placed = placed.select("doc_id", "size", "text_crc32", "tokens", "place", "shard", F.pmod(F.xxhash64(F.lit("slot"), F.col("place")), F.lit(SUB_BUCKETS)).cast("int").alias("sub"))
    placed = checkpointed(placed)

    starts, at = [], {}
    for r in sorted(placed.groupBy("shard", "sub").count().collect(), key=lambda r: (r.shard, r["sub"])):
        starts.append((r.shard, r["sub"], at.get(r.shard, 0)))
        at[r.shard] = at.get(r.shard, 0) + r["count"]
    starts = spark.createDataFrame(starts, "s_shard int, s_sub int, start long")
    number = F.row_number().over(Window.partitionBy("shard", "sub").orderBy("place"))
    numbered = placed.withColumn("number", number.cast("long")).join(F.broadcast(starts), (F.col("shard") == F.col("s_shard")) & (F.col("sub") == F.col("s_sub")))
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")

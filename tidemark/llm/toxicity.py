"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of neighbouring words and of
words two apart (one between them). FTRL-proximal keeps a learning rate for each
coordinate, and its L1 term leaves few weights, which are broadcast: at most
2 ** HASH_BITS of them, whatever the data.

Labels are learned from a bounded sample: at most ``max_rows`` labelled ids, taken by a
seeded hash of the id, with one document each. Scores use the text alone.

Edge cases: null and empty texts have no features and score as the intercept; labels
without a matching document or without a value teach nothing; several labels of an id
count as toxic if one is; of several documents of an id the one with the least text teaches; without any label every score is 0.5, and ``not_toxic`` keeps
every row; repeated rows score alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import require, small_batches, training_row

HASH_BITS = 20
THRESHOLD = 0.3
_SIZE = 1 << HASH_BITS


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of all n-grams and skip-grams, repeats included."""
    w = tc.Words(tc.LOWER[data], offsets, tc.ALNUM_WORD)
    h = tc.segment_hash(tc.prefix_hash(w.data), w.starts, w.ends)
    doc, found = [w.doc], [h]
    for gap, salt in ((1, 0xA5A5A5A5), (2, 0x5C5C5C5D)):
        if len(h) > gap:
            pair = np.flatnonzero(doc[0][gap:] == doc[0][:-gap])
            found.append(tc.mix(h[pair] * tc.BASE + h[pair + gap] + np.uint64(salt)))
            doc.append(doc[0][pair])
    return np.concatenate(doc), (np.concatenate(found) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


class Ftrl:
    """FTRL-proximal: per-coordinate rates from summed squared gradients, L1 and L2."""

    def __init__(self, alpha=1.0, beta=1.0, l1=5.0, l2=0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(_SIZE + 1), np.zeros(_SIZE + 1)  # the last coordinate is the intercept

    def weights(self, i):
        z = self.z[i]
        l1 = np.where(i == _SIZE, 0.0, self.l1)
        shrunk = np.sign(z) * np.maximum(np.abs(z) - l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2)

    def learn(self, i, label):
        w = self.weights(i)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def labelled_sample(docs, labels, id_col, text_col, label_col, max_rows, seed):
    """(order, text, label) of at most max_rows labelled rows that may be learned from."""
    known = labels.where(F.col(label_col).isNotNull() & training_row(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    known = known.withColumn("_order", F.xxhash64(F.lit(seed), F.col("_id"))).orderBy("_order", "_id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id")  # max_rows bounds it
    return rows.groupBy("_id", "_order", "_label").agg(F.min("_text").alias("_text")).select("_order", "_text", "_label")


def trained(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="toxic", max_rows: int = 6000, epochs: int = 4, min_rows: int = 4, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, intercept): the coordinates that L1 has left.

    A coordinate enters the model once ``min_rows`` rows of the sample have it."""
    require(docs, id_col, text_col)
    require(labels, id_col, label_col)
    sample = labelled_sample(docs, labels, id_col, text_col, label_col, max_rows, seed)

    def hashed(batches):
        for batch in batches:
            rows = []
            for first, end, data, offsets in tc.chunks(batch.column(1)):
                doc, feature = features(data, offsets)
                key = np.unique(doc * _SIZE + feature)
                bounds = np.searchsorted(key, np.arange(end - first + 1) * _SIZE)
                rows += [(key[a:b] % _SIZE).astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary()), batch.column(2)], ["ord", "features", "label"])

    def learn(batches):
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort()
        model, rng = Ftrl(), np.random.Generator(np.random.PCG64(seed))
        rows = [(np.frombuffer(f, np.int32).astype(np.int64), y) for _, f, y in rows]
        seen = np.zeros(_SIZE + 1, np.int64)
        for f, _ in rows:
            seen[f] += 1
        rows = [(np.append(f[seen[f] >= min_rows], _SIZE), y) for f, y in rows]
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                model.learn(*rows[i])
        w = model.weights(np.arange(_SIZE + 1))
        kept = np.flatnonzero(w[:-1])
        yield pa.RecordBatch.from_arrays([pa.array([kept.astype(np.int64).tobytes()], pa.binary()), pa.array([w[kept].tobytes()], pa.binary()), pa.array([float(w[-1])])], ["features", "weights", "intercept"])

    table = sample.mapInArrow(hashed, "ord long, features binary, label int")
    fitted = table.repartition(1).mapInArrow(learn, "features binary, weights binary, intercept double").first()
    return np.frombuffer(bytes(fitted.features), np.int64), np.frombuffer(bytes(fitted.weights)), fitted.intercept


def _scores(model, column: pa.Array) -> np.ndarray:
    table, intercept = model
    out = np.zeros(len(column))
    for first, end, data, offsets in tc.chunks(column):
        doc, feature = features(data, offsets)
        hit = np.flatnonzero(table[feature])
        key = np.unique(doc[hit] * _SIZE + feature[hit])
        out[first:end] = np.bincount(key // _SIZE, table[key % _SIZE], end - first)
    return 1 / (1 + np.exp(-np.clip(out + intercept, -30, 30)))


def _unpacked(model) -> tuple[np.ndarray, float]:
    kept, weights, intercept = model
    table = np.zeros(_SIZE)
    table[kept] = weights
    return table, intercept


def scored(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and toxicity, a double from 0 to 1 (replaced if there)."""
    from pyspark.sql.types import StructType

    require(docs, text_col)
    small_batches(docs.sparkSession)
    docs = docs.drop("toxicity")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        own = _unpacked(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_scores(own, batch.column(at)))], [*batch.schema.names, "toxicity"])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("toxicity", "double"))


def not_toxic(docs: DataFrame, model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that score below THRESHOLD; all of them if the model
    has learned nothing (no weights and no intercept), as it cannot tell them apart."""
    kept, _, intercept = model
    if not len(kept) and not intercept:
        return docs
    require(docs, text_col)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        own = _unpacked(shared.value)
        for batch in batches:
            yield batch.filter(pa.array(_scores(own, batch.column(at)) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)

"""Language identification by bit-sliced Bloom filters of n-grams.

One Bloom filter for each language, all with the same hashes, are stored sliced: every
position of the filter holds one bit for each language. A look-up of an n-gram ANDs
the masks at its positions, and the bits left name all languages that hold the n-gram.
Each language's bits are counted over a text; a filter as full as f answers falsely
with probability f ** HASHES, and the counts are corrected for that. The highest
corrected share decides; ties go to the language with more training rows.

N-grams are four characters of the lower-cased letters of a text, a word's border
counting as one. A language's filter holds those found in at least MIN_SHARE of its
training documents, a bounded sample of at most ``max_rows`` a language.

Edge cases: null texts and texts without a letter are ``und`` with score 0; a text none
of whose n-grams is known gets the most frequent language with score 0; a language of
null is never learned; with nothing learned every result is ``und``.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .common import require, small_batches, training_row

GRAM = 4
HASHES = 3
MIN_SHARE = 0.01
BITS_PER_GRAM = 12
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """True for every code point that is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _letters[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash) of every n-gram, and whether each document has a letter."""
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer(("\0".join(lowered) + "\0").encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)
    letter = letters()[points]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    codes = np.where(letter, points, 0)[keep].astype(np.uint64)
    doc = np.searchsorted(ends, np.flatnonzero(keep), "right")
    has = np.bincount(doc[codes > 0], minlength=len(texts)) > 0
    if len(codes) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), has
    inner = codes > 0
    whole = np.ones(len(codes) - GRAM + 1, bool)
    for k in range(1, GRAM - 1):
        whole &= inner[k : k + len(whole)]
    at = np.flatnonzero(whole)
    return doc[at + GRAM - 1], tc.window_hash(codes, GRAM)[at], has


class Filters:
    """Sliced filters: ``slices[position, word]`` has bit l of 64 for language 64 * word + l."""

    def __init__(self, languages: list[str], hashes: list[np.ndarray]):
        self.languages = languages
        most = max([len(h) for h in hashes], default=0)
        self.bits = max(10, int(np.ceil(np.log2(max(1, most * BITS_PER_GRAM)))))
        self.slices = np.zeros((1 << self.bits, max(1, -(-len(languages) // 64))), np.uint64)
        for i, h in enumerate(hashes):
            for position in self.positions(h):
                self.slices[position, i // 64] |= np.uint64(1) << np.uint64(i % 64)
        fill = [np.mean((self.slices[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) for i in range(len(languages))]
        self.false_rate = np.array(fill) ** HASHES

    def positions(self, h: np.ndarray):
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield ((h + np.uint64(k) * step) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def masks(self, h: np.ndarray) -> np.ndarray:
        out = None
        for position in self.positions(h):
            out = self.slices[position] if out is None else out & self.slices[position]
        return out

    def counts(self, doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """(documents, languages): n-grams of each language, corrected for false positives."""
        masks, total = self.masks(h), np.bincount(doc, minlength=n)
        out = np.zeros((n, len(self.languages)))
        for i, rate in enumerate(self.false_rate):
            held = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            hits = np.bincount(doc, held.astype(np.float64), n)
            out[:, i] = np.maximum(0, (hits - rate * total) / max(1e-9, 1 - rate))
        return out


def pieces(column: pa.Array):
    for first, end, _, _ in tc.chunks(column):
        yield first, end, column.slice(first, end - first).to_pylist()


def learning_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int, seed: int) -> tuple[DataFrame, dict[str, int]]:
    """(lang and text of the rows to learn from, number of all such rows by language): of
    each language at most max_rows, those with the least seeded hashes of id and text."""
    known = docs.where(F.col(lang_col).isNotNull() & training_row(F.col(id_col)))
    totals = {r[0]: r[1] for r in known.groupBy(F.col(lang_col).cast("string")).count().collect()}  # a row a language
    place = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    sample = known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), place.alias("place"))
    if max(totals.values(), default=0) > max_rows:
        # Places are random, so a little more than max_rows of a language are below its share of
        # them; the place of the first row too many cuts off, repeated rows at it included.
        share = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, 2.0**63 * min(1.0, 1.25 * max_rows / n) - 2.0**62)])
        sample = sample.where(F.col("place") / 2 <= share[F.col("lang")])
        numbered = sample.select("lang", "place").withColumn("number", F.row_number().over(Window.partitionBy("lang").orderBy("place")))
        for r in numbered.where(F.col("number") == max_rows + 1).collect():  # at most a row a language
            sample = sample.where((F.col("lang") != r.lang) | (F.col("place") < r.place))
    return sample.select("lang", "text"), totals


def trained(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", max_rows: int = 3000, seed: int = 5) -> Filters:
    """Filters from text and language of the rows that may be learned from, at most
    ``max_rows`` of each language."""
    require(docs, id_col, text_col, lang_col)
    small_batches(docs.sparkSession)
    sample, totals = learning_rows(docs, id_col, text_col, lang_col, max_rows, seed)
    if not totals:
        return Filters([], [])

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for first, end, texts in pieces(batch.column(1)):
                doc, h, _ = grams(texts)
                _, at = np.unique(tc.mix(doc.astype(np.uint64) + np.uint64(1)) ^ h, return_index=True)  # once a document
                for lang in sorted(set(langs[first:end])):
                    own = at[langs[first + doc[at]] == lang]
                    values, n = np.unique(h[own], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    least = F.create_map(*[F.lit(x) for lang, n in totals.items() for x in (lang, MIN_SHARE * min(n, max_rows))])
    frequent = counted.where(F.col("n") >= least[F.col("lang")]).select("lang", "gram").collect()  # MIN_SHARE bounds it
    found: dict[str, list[int]] = {lang: [] for lang in sorted(totals, key=lambda k: (-totals[k], k))}
    for r in frequent:
        found[r.lang].append(r.gram)
    return Filters(list(found), [np.sort(np.array(g, np.int64)).view(np.uint64) for g in found.values()])


def predicted(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, lang_pred and lang_score (0 to 1; replaced if there)."""
    from pyspark.sql.types import StructType

    require(docs, text_col)
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    at = docs.columns.index(text_col)

    def run(batches):
        f = shared.value
        names = np.array([*f.languages, UNKNOWN], object)
        for batch in batches:
            best, score = np.full(batch.num_rows, len(f.languages)), np.zeros(batch.num_rows)
            for first, end, texts in pieces(batch.column(at)):
                doc, h, has = grams(texts)
                if not f.languages:
                    continue
                counts = f.counts(doc, h, end - first)
                top = counts.argmax(axis=1)
                total = counts.sum(axis=1)
                best[first:end] = np.where(has, top, len(f.languages))
                score[first:end] = np.where(has & (total > 0), counts.max(axis=1) / np.where(total > 0, total, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add("lang_pred", "string").add("lang_score", "double"))

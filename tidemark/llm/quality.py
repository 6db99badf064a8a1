"""Quality rules of documents and of hosts.

Every document gets measures of its whole text and a verdict of the base rules.
Rule failures are then summed by host; a host's rate of failures is shrunk towards
all hosts by a beta prior fitted to the hosts' rates (method of moments), and a host
whose shrunk rate is too high for any rule takes its documents with it.

Host rules, each a share of the host's documents:
  short     under 20 words
  repeats   over 30 % of the words in repeated 8-word windows
  symbols   over one symbol of ``#*$%&|<>`` for each ten words
  lines     over 30 % of the lines that hold a word repeat an earlier line
  length    mean word length under 2 or over 12 code points

Edge cases: null and empty texts have no words, fail the base rules and count for
their host; a null host is a host of its own; repeated rows count as often as they
occur; an empty table gives an empty result; with one host the prior is its own rate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .common import checkpointed, require

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
RULES = ("short", "repeats", "symbols", "lines", "length")
#: A host is rejected when the shrunk failure rate of some rule is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's strength, in documents.
STRENGTH = (1.0, 1000.0)

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measures(column: pa.Array) -> list[np.ndarray]:
    """The six measures of each text, in the order of MEASURES."""
    out = [np.zeros(len(column), np.int64) for _ in MEASURES]
    for first, end, data, offsets in tc.chunks(column):
        n = end - first
        if not len(data):
            continue
        w = tc.Words(data, offsets, tc.SPACE_WORD)
        rows = slice(first, end)
        out[0][rows] = w.counts
        out[1][rows] = tc.per_doc(w.inside & ((data & 0xC0) != 0x80), offsets)
        out[2][rows] = tc.per_doc(SYMBOL[data], offsets)

        starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1]))
        starts = starts[starts < len(data)]
        ends = np.append(starts[1:], len(data))
        ends = ends - (data[ends - 1] == 10)
        with_word = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
        starts, ends = starts[with_word], ends[with_word]
        doc = np.searchsorted(offsets, starts, "right") - 1
        a, b = tc.identities(data, starts, ends)
        owner = doc.astype(np.uint64)
        order, new = tc.grouped(tc.identity_hash(a, b) ^ tc.mix(owner), owner, a, b)
        out[3][rows] = np.bincount(doc[order[~new]], minlength=n)
        out[5][rows] = np.bincount(doc, minlength=n)

        if len(w.starts) > WINDOW:
            a, b = tc.identities(data, w.starts, w.ends)
            codes = tc.identity_hash(a, b)
            owner = w.doc
            whole = np.flatnonzero(owner[: 1 - WINDOW] == owner[WINDOW - 1 :])
            at = whole[repeated_windows(codes, a, b, owner, whole)]
            cover = np.bincount(at, minlength=len(codes) + 1) - np.bincount(at + WINDOW, minlength=len(codes) + 1)[: len(codes) + 1]
            out[4][rows] = tc.per_doc(np.cumsum(cover)[: len(codes)] > 0, w.bounds)
    return out


def repeated_windows(codes, a, b, owner, starts) -> np.ndarray:
    """Places in ``starts`` of the windows that occur again in their document: by hash
    first, then those that are left by the identities of all their words."""
    key = tc.window_hash(codes, WINDOW)[starts] ^ tc.mix(owner[starts].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    left = order[twice]
    if not len(left):
        return left
    at = starts[left]
    words = [x[at + k] for k in range(WINDOW) for x in (a, b)]
    order, new = tc.grouped(key[left], owner[at], *words)
    again = ~new
    again[:-1] |= ~new[1:]
    return left[order[again]]


def document_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host and the measures of every row."""
    require(docs, id_col, text_col, host_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    schema = slim.drop("text").schema
    for m in MEASURES:
        schema = schema.add(m, "long")

    def run(batches):
        for batch in batches:
            found = measures(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found)], ["doc_id", "host", *MEASURES])

    return slim.mapInArrow(run, schema)


def rule_failures():
    """Conditions of the host rules on the measures."""
    c = F.col
    words = F.greatest(c("n_words"), F.lit(1))
    return {
        "short": c("n_words") < MIN_WORDS,
        "repeats": 100 * c("n_repeat_words") > MAX_REPEAT_PERCENT * c("n_words"),
        "symbols": 10 * c("n_symbols") > words,
        "lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "length": (c("n_words") > 0) & ((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 12 * c("n_words"))),
    }


def host_rates(measured: DataFrame) -> DataFrame:
    """One row a host: host, n_docs, <rule>_rate (shrunk) of each rule and host_failed."""
    fails = [F.sum(cond.cast("long")).alias(f"{r}_fails") for r, cond in rule_failures().items()]
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *fails)
    prior = []
    for r in RULES:
        rate = F.col(f"{r}_fails") / F.col("n_docs")
        prior += [F.avg(rate).alias(f"{r}_mean"), F.var_pop(rate).alias(f"{r}_var")]
    hosts = hosts.crossJoin(F.broadcast(hosts.agg(*prior)))  # the prior is one row
    for r in RULES:
        mean, var = F.col(f"{r}_mean"), F.col(f"{r}_var")
        fitted = F.when(var > 0, mean * (1 - mean) / F.when(var > 0, var) - 1).otherwise(F.lit(STRENGTH[1]))
        strength = F.least(F.greatest(fitted, F.lit(STRENGTH[0])), F.lit(STRENGTH[1]))
        hosts = hosts.withColumn(f"{r}_rate", (F.col(f"{r}_fails") + mean * strength) / (F.col("n_docs") + strength))
    failed = F.greatest(*[F.col(f"{r}_rate") for r in RULES]) > MAX_HOST_RATE
    return hosts.select("host", "n_docs", *[f"{r}_rate" for r in RULES], failed.alias("host_failed"))


def judged(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, host, measures, base_failed, host_failed and kept of every row."""
    measured = checkpointed(document_measures(docs, **columns))
    rates = host_rates(measured).select(F.col("host").alias("h_host"), "host_failed")
    rules = rule_failures()
    out = measured.join(rates, F.col("host").eqNullSafe(F.col("h_host")), "left").drop("h_host")
    out = out.withColumn("base_failed", rules["short"] | rules["repeats"])
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))

"""Mixing sources to target weights, in DataFrame operations only.

Capped water-filling: sources draw words from one budget in proportion to their
weights; a source that would pass its cap (a maximum number of epochs) is clamped
there and what it cannot take is shared among the others by weight, until no
source is above its cap. The fixed point has a closed form: with sources ordered
by cap / weight, the first source at whose water level the budget is used up fixes
the level of all that are not clamped.

A source whose target is r times its size repeats floor(r) times as a whole; the
rest is a seeded sample: documents in the order of a seeded digest of their id and of
their size, as many words as are missing, the last ones in part. So what a document
takes follows from one cut-off a source (``cutoffs``): documents before it are taken
whole, those at it share what is left, those behind it take nothing. The cut-off is
found from sums of buckets of the order and then inside one bucket of each source, so
no task holds a source, and the documents themselves are not moved.

Edge cases: a null source is a source of its own, last in order; null and empty
texts have no words and take none; documents with one id and one size, repeated rows
among them, have one place in the order and take equal parts at the cut-off, rounded
down; null ids are one id; an empty table gives an empty result; long texts are counted
whole. Input columns may have any names but those of the three parameters are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_CHARACTER, checkpointed, require, word_count

#: Buckets of the sampling order in a source: three hexadecimal digits.
BUCKET_DIGITS = 3
#: Up to so many sources' cut-offs, a row each, are broadcast; with more, rows are joined by source.
BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Targets of sources by capped water-filling.

    ``sizes``: rows (source, size) in any number. Returns source, source_size,
    weight and target (double). Weights are dealt to the sources in code-point
    order, null last, again from the first when they run out. If the budget passes
    all caps together, every source gets its cap."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = by_source.withColumn("rank", F.row_number().over(names) - 1)
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.withColumn("weight", F.element_at(dealt, (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    level = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    ranked = (
        ranked.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("caps_below", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_below", F.coalesce(F.sum("weight").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    )
    own = (F.col("budget") - F.col("caps_below")) / (F.col("all_weight") - F.col("weight_below"))
    ranked = ranked.withColumn("own_level", own).withColumn("full_at", F.col("cap") / F.col("weight"))
    ranked = ranked.withColumn("level", F.max(F.when(F.col("full_at") >= F.col("own_level"), F.col("own_level"))).over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def order_digest(id_col: str, seed: int):
    """The seeded place of a document in the order of its source; rows without an id share one."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))


def cutoffs(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row a source: cut_source, source_size, target, copies (whole repetitions),
    cut_digest and cut_size (the cut-off; NULL where all documents are before it) and
    cut_part (words that a document at it takes). ``sized``: source, digest, size."""
    buckets = sized.groupBy("source", F.substring("digest", 1, BUCKET_DIGITS).alias("bucket")).agg(F.sum("size").alias("size"))
    buckets = checkpointed(buckets)
    targets = source_targets(buckets.select("source", "size"), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = targets.withColumn("copies", whole)
    targets = targets.withColumn("quota", F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("long"))
    targets = checkpointed(targets.select(F.col("source").alias("cut_source"), "source_size", "target", "copies", "quota"))

    own = F.col("source").eqNullSafe(F.col("cut_source"))
    buckets = buckets.withColumn("start", F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    holds = (F.col("start") <= F.col("quota")) & (F.col("quota") < F.col("start") + F.col("size"))
    edge = buckets.join(targets, own).where(holds).select(F.col("source").alias("e_source"), F.col("bucket").alias("e_bucket"), "start", "quota")
    edge = checkpointed(edge)  # a bucket a source

    inside = F.col("source").eqNullSafe(F.col("e_source")) & (F.substring("digest", 1, BUCKET_DIGITS) == F.col("e_bucket"))
    places = sized.join(_small(edge), inside).groupBy("source", "digest", "size", "start", "quota").agg(F.count(F.lit(1)).alias("rows"))
    order = Window.partitionBy("source").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("start", F.col("start") + F.coalesce(F.sum(F.col("rows") * F.col("size")).over(order), F.lit(0)))
    at = places.where((F.col("start") <= F.col("quota")) & (F.col("quota") < F.col("start") + F.col("rows") * F.col("size")))
    part = F.floor((F.col("quota") - F.col("start")) / F.col("rows")).cast("long")
    at = at.select(F.col("source").alias("a_source"), F.col("digest").alias("cut_digest"), F.col("size").alias("cut_size"), part.alias("cut_part"))
    found = targets.join(at, F.col("cut_source").eqNullSafe(F.col("a_source")), "left")
    return checkpointed(found.select("cut_source", "source_size", "target", "copies", "cut_digest", "cut_size", "cut_part"))


def _small(rows: DataFrame) -> DataFrame:
    """Rows to broadcast if they are few enough, counted first."""
    return F.broadcast(rows) if rows.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else rows


def taken_part(digest, size):
    """Words of its partial repetition that a document takes, by its source's cut-off.
    ``size`` is looked at only where it matters."""
    same = digest == F.col("cut_digest")
    early = F.col("cut_digest").isNull() | (digest < F.col("cut_digest")) | (same & (size < F.col("cut_size")))
    return F.when(early, size).when(same & (size == F.col("cut_size")), F.col("cut_part")).otherwise(F.lit(0).cast("long"))


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order_digest(id_col, seed).alias("digest"))
    return checkpointed(slim)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """One row a document: doc_id, size, source, source_size, target, copies (whole
    repetitions), part (words of one more, partial repetition) and taken (words in all)."""
    require(docs, id_col, text_col, source_col)
    slim = sizes(docs, id_col, text_col, source_col, seed)
    cuts = cutoffs(slim, weights, share, max_epochs)
    rows = slim.join(_small(cuts), F.col("source").eqNullSafe(F.col("cut_source")))
    rows = rows.withColumn("part", taken_part(F.col("digest"), F.col("size")))
    return rows.select("doc_id", "size", "source", "source_size", "target", "copies", "part", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7) -> DataFrame:
    """The mix as rows of ``docs``: each document as often as the mix takes it whole.

    A partial repetition counts when at least half of the document lies in the quota;
    texts are not cut. Documents that the mix does not take stay away; documents
    without words are kept once, as they cost nothing. Rows are repeated where they are."""
    require(docs, id_col, text_col, source_col)
    cuts = cutoffs(sizes(docs, id_col, text_col, source_col, seed), weights, share, max_epochs)
    # The input's columns go into one struct, so that none can clash with a column made here.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"), order_digest(id_col, seed).alias("digest"), F.col(text_col).alias("text"))
    joined = held.join(_small(cuts), F.col("source").eqNullSafe(F.col("cut_source")))
    digest, size = F.col("digest"), word_count(F.col("text"))
    early = F.col("cut_digest").isNull() | (digest < F.col("cut_digest"))
    half = (size == F.col("cut_size")) & (F.col("cut_part") > 0) & (2 * F.col("cut_part") >= size)
    at = F.when((size < F.col("cut_size")) | half, 1).otherwise(0)  # only documents at the cut-off have their words counted
    more = F.when(early, 1).when(digest == F.col("cut_digest"), at).otherwise(0)
    wordless = ~F.coalesce(F.col("text").rlike(WORD_CHARACTER), F.lit(False))
    times = F.when(wordless, F.lit(1).cast("long")).otherwise(F.col("copies") + more)
    out = joined.withColumn("times", times).where("times > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")

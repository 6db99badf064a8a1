"""Corpus pipeline: documents to a mixed, clean and sharded training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written
and read again as the next one's docs. All but the last keep the columns of documents.

  toxicity        rejects documents that the model, trained on labels, scores as toxic; none if no label could be learned
  near_dedup      keeps one document of each group linked by 0.8 of their shingles in common
  decontaminate   drops documents in which ten words of a benchmark item occur in a row
  mix             repeats and samples documents until the sources meet their weights
  shard           one row for each document of the mix: its shard and its slot there

Edge cases, besides those of the operators: null and empty texts are kept, one of them all,
as they are near copies of each other; rows without an id are never near copies; without
labels or benchmark items the stages keep every row; empty documents give an empty result;
further columns of documents, of any name, go through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, mixing, nearcopies, sharding, toxicity
from tidemark.llm.common import checkpointed, delete_folder, shared_folder, table

#: Near duplicates have 0.8 of their five-word shingles in common. They are sought among texts
#: that agree on two of the DISTANCE + 2 segments of one of FAMILY fingerprints.
SHINGLE_WORDS, DISTANCE, FAMILY = 5, 6, 4


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    return toxicity.not_toxic(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.one_of_each(docs, DISTANCE, shingle=SHINGLE_WORDS, family=FAMILY)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_matches(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeated(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_duplicates),
    ("decontaminate", without_benchmark),
    ("mix", mixed),
    ("shard", sharded),
]

#: A trained model and fingerprints by XXH64 decide, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for name, stage in STAGES[:-1]:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
        return checkpointed(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        delete_folder(spark, folder)

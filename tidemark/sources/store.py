"""Reading and writing tables, and cutting lineage in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, else one in its warehouse (a local session without either setting)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return context.getCheckpointDir()


def checkpointed(rows: DataFrame) -> DataFrame:
    """A reliable checkpoint: it survives lost executors and cuts the lineage.

    It is planned without constraint propagation: a checkpoint keeps the constraints of
    its plan, and those on columns that were renamed since break later unions."""
    spark = rows.sparkSession
    shared_folder(spark)
    option = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(option)
    spark.conf.set(option, "false")
    try:
        return rows.checkpoint(eager=True)
    finally:
        spark.conf.set(option, before)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``; columns and filters are pushed into the scan by the plans on it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_table(rows: DataFrame, path: str, mode: str = "error", partition_by: tuple[str, ...] = ()) -> None:
    writer = rows.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)

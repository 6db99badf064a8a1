"""Change logs: Structured Streaming from an append-only folder of Z-sets to a database.

A log holds the columns of one table and ``_d``. Micro-batches are applied through
``foreachBatch``. Each batch is first kept in the store of the log, under its number; a
batch that is delivered again after a failure is found there and changes nothing. Tables
live with their process: a new one registers the table as it was at first, and the log
that is opened with the same store applies what the store has, so the stream can go on
from its own checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..database import Database


def append(rows: DataFrame, path: str, weight: int = 1) -> None:
    """Write rows to the log as inserts (1) or deletes (-1)."""
    from .zset import weighted

    weighted(rows, weight).write.mode("append").parquet(path)


class ChangeLog:
    def __init__(self, db: Database, table: str, path: str, store: str | None = None):
        self.db, self.table, self.path = db, table, path
        self.store = store or f"{path.rstrip('/')}-applied"
        self.applied = max(self._kept(), default=-1)
        if self.applied >= 0:
            self.db.apply_delta(self.table, self.db.spark.read.schema(self._schema()).parquet(*[self._batch(n) for n in self._kept()]))

    def _schema(self) -> StructType:
        return StructType([*self.db.table(self.table).schema.fields, StructField("_d", LongType())])

    def _batch(self, number: int) -> str:
        return f"{self.store}/batch-{number:012d}"

    def _kept(self) -> list[int]:
        """Numbers of the batches in the store that were written whole."""
        spark = self.db.spark
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.store}/batch-*/_SUCCESS")
        found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder) or []
        return sorted(int(f.getPath().getParent().getName().rpartition("-")[2]) for f in found)

    def apply(self, batch: DataFrame, number: int) -> None:
        if number <= self.applied:
            return
        batch.write.mode("overwrite").parquet(self._batch(number))
        self.db.apply_delta(self.table, self.db.spark.read.schema(self._schema()).parquet(self._batch(number)))
        self.applied = number

    def start(self, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Follow the log; with ``available_now`` the query ends when it has caught up."""
        stream = self.db.spark.readStream.schema(self._schema()).option("maxFilesPerTrigger", 64).parquet(self.path)
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

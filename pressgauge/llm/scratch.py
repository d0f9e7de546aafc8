"""Cutting lineage in the folder that all executors share, and choosing joins by a checked size."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.session import shared_dir

#: Sides of at most this many narrow rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: The same for sides with lists: bytes of all lists together.
BROADCAST_BYTES = 16 << 20

#: Whether Spark deletes shuffle files at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a batch of texts that goes between Spark and Python: some MB, where Spark's own 10,000 rows are tens of MB in
#: the buffers of either side.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Let batches of rows for Python be small from here on, unless the session has a setting of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, BATCH_ROWS)


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the files.

    The table is whole and replicated by the file system, so a lost executor costs at most the tasks it ran.
    """
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """Tables cut on the way to a result; they are deleted together when the result itself has been written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, new_dir(spark, name)

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        # What was shuffled for a table is of no use once it is written; else it stays until the driver collects garbage.
        kept = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, kept)
        return self.spark.read.schema(df.schema).parquet(path)

    def cut_small(self, df: DataFrame, name: str) -> DataFrame:
        """The same for what is small beside what it is made from: written in few files, whatever the tasks that made it."""
        files = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)
        return self.cut(df.repartition(files), name)

    def part(self, name: str) -> Workspace:
        """A workspace of its own within this one, for tables that are of no use beyond a step."""
        part = Workspace(self.spark, name)
        part.path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        return part

    def close(self) -> None:
        """Delete all tables; nothing that reads them may be evaluated later."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def small_side(df: DataFrame, size: Column | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is small, else ``df`` for a shuffled join.

    Small is at most ``limit`` rows and, where the rows hold lists of ``size`` bytes, ``BROADCAST_BYTES`` in all.
    """
    if size is None:
        return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
    rows, total = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()
    return F.broadcast(df) if rows <= limit and total <= BROADCAST_BYTES else df

"""Spark session used by the command line tools, the benchmark and the tests."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether Spark deletes shuffle files at the end of a query.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A table of at most this many narrow rows is sent to the rows that it is joined with; a larger one is joined by a shuffle.
SMALL_ROWS = 500_000


def build_session(app: str = "pressgauge", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; ``master=None`` leaves the choice to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": os.environ.get("PRESSGAUGE_UI", "false"),
        **conf,
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    return builder.config(map=settings).getOrCreate()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, as Spark reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one only for a local master where none is set, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Steps:
    """Tables written to the shared folder on the way to a result, compressed; ``close`` deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark).rstrip('/')}/steps-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written once, with its lineage cut."""
        return self.keep_all([df])

    def keep_all(self, parts: Iterable[DataFrame]) -> DataFrame:
        """The rows of tables of one schema, written one after the other."""
        path, schema = f"{self.path}/{uuid.uuid4().hex}", None
        # What was shuffled for a table is of no use once it is written; else it stays until the driver collects garbage.
        kept = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            for df in parts:
                df.write.mode("append").parquet(path)
                schema = df.schema
        finally:
            self.spark.conf.set(CLEANUP, kept)
        return self.spark.read.schema(schema).parquet(path)

    def close(self) -> None:
        """Delete all tables; nothing that reads them may be evaluated later."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut; it stays for results that read it."""
    return Steps(df.sparkSession).keep(df)


def small_side(df: DataFrame) -> DataFrame:
    """A written table, to be sent around if it has few rows."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that is broadcast; beyond that Spark shuffles both sides.
SMALL_ROWS = 500_000


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only where that is unset on a single machine (as
    in tests) one under /tmp: on a cluster, executors would not see each other's files there."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file:///tmp/factlake-tables"
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table, so that what reads it several times computes it once."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A written table: to be broadcast if its rows, counted, are few."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def few_or_merged(table: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A written table: broadcast if its rows, counted, are few, else joined by sorting both sides. Without
    a word Spark may broadcast the other side: it takes exploded rows for as few as there were before."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table.hint("merge")


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

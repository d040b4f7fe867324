"""What the operators of this subpackage share: reading tables, intermediate tables, words."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the ASCII controls 9-13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; every other column, whatever its name, stays unread."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def columns(frame: DataFrame) -> list[Column]:
    """All columns of a table, whatever is in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in frame.columns]


def packed(frame: DataFrame) -> Column:
    """A row as one column, so that no name of the table meets a name of the operator's."""
    return F.struct(*columns(frame)).alias("_row")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where that is unset on a single machine (as in tests) it is a folder under /tmp.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file:///tmp/factlake-shared"
    return path.rstrip("/")


#: Paths written inside the jobs that run now, innermost last.
_written: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again, which cuts its lineage:
    lost executors cost a re-read, not a recomputation."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.__dict__["_stored_at"] = path
    return out


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for t in tables:
        if path := t.__dict__.get("_stored_at"):
            discard(t.sparkSession, path)


def job(fn):
    """An operator whose result is a stored table: while it runs, batches to Python are bounded, and
    when its result is written, its other tables are deleted. The session's settings stay as they were.

    Results that hold whole texts are not made jobs of: they read what was stored, and are not
    written twice.
    """

    @wraps(fn)
    def run(rows: DataFrame, *args, **named) -> DataFrame:
        made: list[str] = []
        _written.append(made)
        try:
            with small_batches(rows.sparkSession):
                out = stored(fn(rows, *args, **named), fn.__name__)
        finally:
            _written.pop()
        path = out.__dict__["_stored_at"]
        for other in made:
            if other != path:
                discard(rows.sparkSession, other)
        if _written:
            _written[-1].append(path)
        return out

    return run


#: Bytes and rows of a batch that goes to Python, at most; a row with more is a batch of its own.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2000
#: Rows of up to five numbers that are broadcast; beyond that Spark shuffles both sides.
SMALL_ROWS = 500_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bounds what a Python task holds at once, by bytes, so that long texts come few at a time.
    Holds for what is run inside; then the session has its own settings again."""
    held = {}
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        key = f"spark.sql.execution.arrow.{key}"
        held[key] = spark.conf.get(key)
        own = re.match(r"-?\d+", held[key])
        if own is None or not 0 < int(own[0]) <= most:
            spark.conf.set(key, most)
    try:
        yield
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)


def small(written: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A written table of a few numbers a row: to be broadcast if its rows, counted, are few."""
    return F.broadcast(written) if written.limit(rows + 1).count() <= rows else written


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

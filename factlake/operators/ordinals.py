"""Places of rows in an ordered table, and tables that meet by place.

Ordinals by two passes: tasks number their rows, their totals are summed up, a row a task, and every row
adds its task's offset. So no task sees all rows, and ordinals are gapless.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import small, written


def with_ordinals(rows: DataFrame, order: list[Column], name: str = "place", descending: bool = False) -> DataFrame:
    """rows with their place from 0 in this order; rows that are equal in it keep the order in which they are
    read, and are dealt by it, so that very many of them are several tasks' work."""
    names = [f"_o{i}" for i in range(len(order))]
    keyed = rows.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)], F.monotonically_increasing_id().alias("_read"))
    by = [*[F.desc(n) if descending else F.asc(n) for n in names], F.asc("_read")]
    dealt = keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop(*names, "_read")
    dealt = written(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "dealt")
    held = dealt.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a task
    shift = small(written(held.select("_part", (before - F.col("first")).alias("_shift")), "shift"))
    return dealt.join(shift, "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def by_place(lists: dict[str, DataFrame], place: str = "place") -> DataFrame:
    """place and a struct for each list, null beyond its end: rows of lists of any lengths that have the same
    place. All lists are dealt by place once."""
    named = [rows.select(place, F.struct(*[c for c in rows.columns if c != place]).alias(name)) for name, rows in lists.items()]
    return reduce(lambda a, b: a.join(b, place, "full"), named)


def slice_of(rows: DataFrame, start: int = 0, limit: int | None = None, place: str = "place") -> DataFrame:
    """The rows from place `start` on, `limit` at most, so that work can be done in parts."""
    kept = rows.where(F.col(place) >= start)
    return kept if limit is None else kept.where(F.col(place) < start + limit)

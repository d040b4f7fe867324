"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction. Each node u learns the least of itself and its neighbours; its larger
    neighbours (large star), or its smaller ones and itself (small star), are tied to that.

    The least neighbour is a min() that is partly formed before the shuffle, so a node with very
    many neighbours costs a row per task; the join back is of one row per node and splits by AQE.
    """
    if large:
        links = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = links.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where("a > b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the edges: root is the least node that links reach.

    Self-links and repeated links change nothing; null ends are left out; no links, no rows.
    Runs entirely as joins and aggregates; each round is written to the shared folder, and the
    rounds end when the set of edges stays as it was.
    """
    x = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    x = stored(x.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen = tuple(mark)
        before, x = x, stored(_star(_star(x, True), False), "edges")
        release(before)
    return x.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        x.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )

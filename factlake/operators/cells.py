"""Nearest vectors without looking at all: a coarse partition into cells, and an exact stopping bound.

Every vector belongs to the cell of the centre nearest to it, and a cell knows the largest angle of a member.
A query at angle t to a centre has no member of a cell of radius r nearer than the angle t - r. So a query
first looks into the cells nearest to it until they have k members, which gives a threshold, and then into
every other cell whose bound reaches it. No vector is left out of the index, and no result is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written

#: Centres at most, which tasks hold; centres for the root of the number of vectors; queries that are looked
#: up at once; slack for rounding.
CENTRES, SHARE, QUERIES, SLACK = 4096, 4, 4096, 1e-6
#: Cosines that a task works out at once.
PRODUCTS = 1 << 20


def units(rows: DataFrame, key: str, group: str | None) -> DataFrame:
    """key, g, v (doubles of length one). Vectors that are null, empty or zero, or hold null or non-finite
    components, are near nothing and are left out. g: the group, one for all without."""
    v = F.col("embedding").cast("array<double>")
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    g = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))  # so that squares neither vanish nor overflow
    scaled = rows.where(good).select(key, g.alias("g"), v.alias("v")).withColumn("v", F.transform("v", lambda x: x / most))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return scaled.withColumn("v", F.transform("v", lambda x: x / size))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 1))


def _by_length(batch: pd.DataFrame, length: int) -> pd.DataFrame:
    return batch[batch["v"].map(len) == length]


def build(vectors: DataFrame, key: str = "vec_id", group: str | None = None, centres: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The index: members (key, g, cell, v), written by cell, and cells (g, cell, n, radius, centre).

    Centres are the vectors with the least hashes, SHARE times the root of their number if not told, CENTRES at
    most. Vectors of another length than most are in cell -1, which only queries of such lengths look at.
    """
    rows = written(units(vectors, key, group), "units")
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").select("d").first()
    length = length[0] if length else 1
    wanted = min(CENTRES, centres or SHARE * math.isqrt(rows.count()) + 1)
    chosen = rows.where(F.size("v") == length).orderBy(F.xxhash64("v"), key).select("v").limit(wanted).collect()
    points = np.array([r.v for r in chosen], np.float64).reshape(-1, length)
    kind = rows.schema[key].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell, angle = np.full(len(batch), -1), np.full(len(batch), np.pi)
            at = np.flatnonzero((batch["v"].map(len) == length).to_numpy())
            if len(at):
                near = _matrix(batch["v"].iloc[at]) @ points.T
                cell[at] = near.argmax(axis=1)
                angle[at] = np.arccos(np.clip(near.max(axis=1), -1, 1))
            yield batch.assign(cell=cell, angle=angle)

    members = written(rows.mapInPandas(assign, f"{key} {kind}, g string, v array<double>, cell int, angle double"), "members")
    cells = members.groupBy("g", "cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    where = members.sparkSession.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "cell int, centre array<double>")
    # what a task reads is of few cells: rows of a cell are neighbours
    dealt = written(members.drop("angle").repartitionByRange("g", "cell", key).sortWithinPartitions("g", "cell", key), "cells")
    return dealt, written(cells.join(F.broadcast(where), "cell", "left"), "centres")


def _bounds(queries: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """key, g, cell, n, bound: the largest cosine that a member of the cell can have to the query."""
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(F.zip_with("v", "centre", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))))
    away = F.greatest(F.lit(0.0), angle - F.col("radius"))
    known = F.col("centre").isNotNull() & (F.size("v") == F.size("centre"))
    same = F.when(F.col("cell") < 0, F.lit(1.0)).when(known, F.cos(away))  # other lengths meet in cell -1 only
    return queries.join(F.broadcast(cells), "g").select(key, "g", "cell", "n", same.alias("bound")).where("bound is not null")


def _look(members: DataFrame, key: str, of: pa.Table, k: int) -> DataFrame:
    """qid, key, score: of each query the k best members of each batch of the cells that it looks into.
    of: (qid, g, cells, v), QUERIES at most, which go to the tasks."""
    names, groups, points, cells = (of[c].to_pylist() if c in ("qid", "g") else [x.values.to_numpy() for x in of[c]] for c in ("qid", "g", "v", "cells"))
    at: dict[tuple[str, int], np.ndarray] = {}  # four bytes a query and cell
    for g in set(groups):
        mine = [i for i, h in enumerate(groups) if h == g]
        cell, who = np.concatenate([cells[i] for i in mine]), np.repeat(np.array(mine, np.int32), [len(cells[i]) for i in mine])
        order = np.argsort(cell, kind="stable")
        of_cell, starts = np.unique(cell[order], return_index=True)
        at |= {(g, int(c)): asking for c, asking in zip(of_cell, np.split(who[order], starts[1:]), strict=True)}
    kind = members.schema[key].dataType.simpleString()

    def best(ids: np.ndarray, score: np.ndarray, these: np.ndarray) -> pd.DataFrame:
        """Of each query the k best and itself, and what equals the last of these but for rounding."""
        if len(ids) > k + 1:
            least = np.partition(score, -(k + 1), axis=0)[-(k + 1)] - SLACK
            row, column = np.nonzero(score >= least)
        else:
            row, column = (x.ravel() for x in np.indices(score.shape))
        return pd.DataFrame({"i": these[column], key: ids[row], "score": score[row, column]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (g, c), rows in batch.groupby(["g", "cell"], sort=False):
                asking = at.get((g, int(c)), ())
                for length in {len(points[i]) for i in asking}:
                    mine = _by_length(rows, length)
                    these = np.array([i for i in asking if len(points[i]) == length])
                    vectors, ids = _matrix(mine["v"]), mine[key].to_numpy()
                    if not len(ids):
                        continue
                    step = max(1, PRODUCTS // len(ids))  # so many queries at once that their products are few
                    for j in range(0, len(these), step):
                        some = these[j : j + step]
                        yield best(ids, vectors @ np.stack([points[i] for i in some]).T, some)

    found = members.where(F.array_contains(F.array(*[F.lit(c) for c in sorted({c for _, c in at})]), F.col("cell"))) if at else members.limit(0)
    rows = found.select(key, "g", "cell", "v").mapInPandas(run, f"i int, {key} {kind}, score double")
    which = members.sparkSession.createDataFrame(list(enumerate(names)), "i int, qid " + kind)
    return rows.join(F.broadcast(which), "i").where(~F.col("qid").eqNullSafe(F.col(key))).select("qid", key, "score")


def search(index: tuple[DataFrame, DataFrame], queries: DataFrame, k: int, key: str = "vec_id", group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(qid, key, score, rank): the k nearest by cosine, rounded to 6 places, ties by key, itself aside; and
    (qid, cells, looked, members, compared): how many cells there are, and into how many was looked.

    queries: key, embedding, group; each key once. They are a stated set: QUERIES of them at a time go to the
    tasks, with the cells that they look into.
    """
    members, cells = index
    asked = written(units(queries, key, group), "asked")
    bounds = written(_bounds(asked, cells, key), "bounds")
    order = Window.partitionBy(key).orderBy(F.desc("bound"), "cell")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = written(bounds.withColumn("first", before <= k), "ranked")  # cells until k others are among them
    blocks = max(1, -(-asked.count() // QUERIES))
    results, reports = None, None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b)
        one = _phase(members, ranked.where("first"), mine, key, k)
        worst = one.groupBy("qid").agg(F.min("score").alias("least"), F.count("*").alias("found"))
        more = ranked.where("not first").join(worst, ranked[key].eqNullSafe(worst["qid"]), "left")
        more = more.where(F.col("least").isNull() | (F.col("found") < k) | (F.col("bound") >= F.col("least") - SLACK)).select(key, "g", "cell", "n")
        more = written(more.join(mine.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_semi"), "more")
        two = _phase(members, more, mine, key, k)
        best = _best(one.unionByName(two), key, k)
        looked = ranked.where("first").select(key, "n").join(mine.select(F.col(key).alias("_k")), F.col(key).eqNullSafe(F.col("_k")), "left_semi").unionByName(more.select(key, "n"))
        report = looked.groupBy(F.col(key).alias("qid")).agg(F.count("*").alias("looked"), F.sum("n").alias("compared"))
        results = best if results is None else results.unionByName(best)
        reports = report if reports is None else reports.unionByName(report)
    all_cells = ranked.groupBy(F.col(key).alias("qid")).agg(F.count("*").alias("cells"), F.sum("n").alias("members"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))
    return results.withColumn("rank", rank).select("qid", key, "score", "rank"), all_cells.join(reports, "qid").select("qid", "cells", "looked", "members", "compared")


def _best(rows: DataFrame, key: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _phase(members: DataFrame, cells: DataFrame, queries: DataFrame, key: str, k: int) -> DataFrame:
    """The k best of each query from its cells; written, as the next phase reads it twice."""
    lists = cells.groupBy(F.col(key).alias("_k")).agg(F.collect_list("cell").alias("cells"))  # CENTRES at most
    of = queries.join(lists, F.col(key).eqNullSafe(F.col("_k"))).select(F.col(key).alias("qid"), "g", "cells", "v").toArrow()  # QUERIES at most
    found = _look(members, key, of, k).withColumn("score", F.round("score", 6))
    return written(_best(found, key, k), "nearest")

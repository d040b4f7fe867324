"""Near duplicates among embeddings, by tiled comparison in PCA order.

Vectors are scaled to length one and turned into their principal axes. Equal vectors are one
class, so copies cost one comparison. Classes are cut into blocks of neighbours, by quantiles of the
first axis, of the second within these, and of the third. A block has a box: its bounds on the BOX
leading axes and on the length of what the others hold. Blocks whose boxes are further apart than
linked vectors can be are never paired. In a pair of blocks, tiles are compared on the leading axes first: what the others can add to a product is at most the product
of the two suffix lengths, and pairs that cannot reach the threshold stop there. The others'
cosines are worked out in double precision. A pair of blocks returns each class's number of links
and a spanning forest of them, not the links.

Defined results: a null, empty or zero vector, or one with a null or non-finite component, links
with nothing and is its own component. So do vectors of different lengths towards each other. Rows
that share a vec_id are vectors of their own, which get the same component_id when linked. A null
vec_id links, but names no component while another member does. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import job, stored, table
from .graph import components

THRESHOLD = 0.9
#: Classes in a tile; the leading share of axes; slack for rounding in float32; axes of a box.
TILE, LEADING, SLACK, BOX = 1024, 0.375, 1e-5, 8
#: Blocks to cut a table into, as long as they hold so many classes at least and at most, and bytes at most.
BLOCKS, LEAST, BLOCK, BLOCK_BYTES = 16, 1024, 65_536, 32 << 20
_LOWEST = -(2**63)


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Vectors of length one with a hash of what they were; dim 0 for those that never link."""
    for batch in batches:
        keys, dims, units = [], [], []
        for x in batch.pop("embedding"):
            v = np.array([] if x is None else x, np.float64)  # null components become nan
            size = np.abs(v).max() if v.size and np.isfinite(v).all() else 0.0
            if size > 0:
                keys.append(int(np.uint64(xxhash.xxh3_64_intdigest(v.tobytes())).view(np.int64)))
                v = v / size
                units.append((v / np.sqrt(v @ v)).tobytes())
                dims.append(len(v))
            else:
                keys.append(0)
                units.append(b"")
                dims.append(0)
        yield batch.assign(key=keys, dim=dims, unit=units)


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for batch in batches:
        if len(batch):
            m = _matrix(batch["unit"])
            total = m.T @ m + (0 if total is None else total)
    if total is not None:
        yield pd.DataFrame({"group": [int(xxhash.xxh3_64_intdigest(total.tobytes()) % 8)], "m": [total.tobytes()]})


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float64) for x in rows["m"])
    return pd.DataFrame({"m": [total.tobytes()]})


def _matrix(blobs: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def principal_axes(classes: DataFrame, dim: int) -> np.ndarray:
    """The axes, as columns, strongest first: of the sums of products over all classes, which tasks
    form and eight groups add up."""
    sums = classes.select("unit").mapInPandas(_moments, "group int, m binary").groupBy("group").applyInPandas(_summed, "m binary").collect()
    total = sum(np.frombuffer(r[0], np.float64) for r in sums).reshape(dim, dim)
    return np.linalg.eigh(total)[1][:, ::-1]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least member of each component) after these links."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def compare(a: np.ndarray, b: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows of a and b, tile by tile; vectors of length one in principal axes."""
    lead = max(1, math.ceil(LEADING * a.shape[1]))
    heads = [m[:, :lead].astype(np.float32) for m in (a, b)]
    rests = [np.sqrt((m[:, lead:] ** 2).sum(axis=1)).astype(np.float32) for m in (a, b)]
    for i in range(0, len(a), TILE):
        for j in range(0, len(b), TILE):
            bound = heads[0][i : i + TILE] @ heads[1][j : j + TILE].T
            bound += rests[0][i : i + TILE, None] * rests[1][None, j : j + TILE]
            x, y = np.nonzero(bound >= threshold - SLACK)
            if len(x) > bound.size // 16:
                cosine = a[i : i + TILE] @ b[j : j + TILE].T
                x, y = np.nonzero(cosine >= threshold)
            elif len(x):
                x, y = x + i, y + j
                hit = np.einsum("ij,ij->i", a[x], b[y]) >= threshold
                yield x[hit], y[hit]
                continue
            yield x + i, y + j


def _block_pair(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        same = right.empty  # a block with itself
        right = left if same else right
        key = np.r_[left["key"], right["key"]]
        weight = np.r_[left["copies"], right["copies"]].astype(np.float64)
        links, label = np.zeros(len(key)), np.arange(len(key))
        for x, y in compare(_matrix(left["unit"]), _matrix(right["unit"]), threshold):
            if same:
                x, y = x[x != y], y[x != y]
            y = y + len(left)
            links += np.bincount(x, weight[y], len(key))
            if not same:
                links += np.bincount(y, weight[x], len(key))
            label = _merge(label, x, y if not same else y - len(left))
        counted, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(key)))
        out = pd.DataFrame({"a": np.r_[key[counted], key[moved]], "n": np.r_[links[counted], np.zeros(len(moved))].astype(np.int64)})
        out["b"] = pd.array([None] * len(counted) + key[label[moved]].tolist(), "Int64")
        return out[["a", "b", "n"]]

    return run


def _below(cuts: Column, axis: str) -> Column:
    return F.size(F.filter(cuts, lambda c: c <= F.col(axis)))


def _cells(rows: DataFrame, count: int) -> tuple[list[dict[int, np.ndarray]], list[int]]:
    """Cuts of rows (x0, x1, x2) into about `count` cells: for each axis and cell so far, where it
    is cut; and the number of parts a cell is cut into on each axis."""
    axes = [c for c in ("x0", "x1", "x2") if c in rows.columns]
    splits, left = [], count
    for i in range(len(axes)):
        splits.append(math.ceil(left ** (1 / min(2, len(axes) - i))))
        left = math.ceil(left / splits[-1])
    cuts, cell = [], F.lit(0)
    for axis, n in zip(axes, splits, strict=True):
        if n == 1:
            cuts.append({})
            continue
        inner = [i / n for i in range(1, n)]
        found = rows.groupBy(cell.alias("cell")).agg(F.percentile_approx(axis, inner, 1000 * n).alias("cuts")).collect()  # a row per cell
        cuts.append({r.cell: np.array(r.cuts) for r in found})
        at = F.create_map(*[x for r in found for x in (F.lit(r.cell), F.array(*[F.lit(c) for c in r.cuts]))])
        cell = cell * n + _below(at[cell], axis)
    return cuts, splits


def _cell_of(batch: pd.DataFrame, cuts: list[dict[int, np.ndarray]], splits: list[int]) -> np.ndarray:
    cell = np.zeros(len(batch), np.int64)
    for i, (cut, n) in enumerate(zip(cuts, splits, strict=True)):
        if cut:
            within = np.zeros(len(batch), np.int64)
            for c in np.unique(cell):
                at = cell == c
                within[at] = np.searchsorted(cut[int(c)], batch[f"x{i}"].to_numpy()[at], side="right")
            cell = cell * n + within
    return cell


def _blocks(classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(a, b, n): links n of class a where b is null, else a link of the forest."""
    axes, boxed = principal_axes(classes, dim), min(BOX, dim)
    sides = [f"x{i}" for i in range(boxed)] + ["rest"]

    def rotate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = (_matrix(batch["unit"]) @ axes) if len(batch) else np.zeros((0, dim))
            out = batch.assign(unit=[x.tobytes() for x in m], **{f"x{i}": m[:, i] for i in range(boxed)})
            yield out.assign(rest=np.sqrt((m[:, boxed:] ** 2).sum(axis=1)))

    spark, doubles = classes.sparkSession, "".join(f", {c} double" for c in sides)
    turned = stored(classes.select("key", "copies", "unit").mapInPandas(rotate, "key bigint, copies bigint, unit binary" + doubles), "turned")
    total = turned.count()
    block = max(1, min(BLOCK, BLOCK_BYTES // (8 * dim), max(LEAST, math.ceil(total / BLOCKS))))
    cuts, splits = _cells(turned.select(*sides), math.ceil(total / block))

    def celled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(cell=_cell_of(batch, cuts, splits))

    turned = stored(turned.mapInPandas(celled, "key bigint, copies bigint, unit binary" + doubles + ", cell bigint"), "celled")
    bounds = [f(c).alias(f"{n}_{c}") for c in sides for n, f in (("lo", F.min), ("hi", F.max))]
    boxes = sorted(turned.groupBy("cell").agg(F.count("*").alias("n"), *bounds).collect(), key=lambda r: r.cell)  # a row per cell
    # where many classes have the same place, a cell is cut by hash as well
    parts = np.array([max(1, math.ceil(r.n / (1.5 * block))) for r in boxes])
    first = dict(zip([r.cell for r in boxes], zip((np.cumsum(parts) - parts).tolist(), parts.tolist(), strict=True), strict=True))
    low, high = (np.repeat(np.array([[r[f"{n}_{c}"] for c in sides] for r in boxes]).reshape(len(boxes), -1), parts, axis=0) for n in ("lo", "hi"))
    plan = spark.sparkContext.broadcast((first, low, high))
    reach = 2 - 2 * threshold + 1e-9

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, low, high = plan.value
        for batch in batches:
            hashed = (batch["key"].to_numpy().view(np.uint64) >> np.uint64(1)).astype(np.int64)
            start, count = (np.array([of[c][i] for c in batch["cell"].tolist()], np.int64) for i in (0, 1))
            own = start + hashed % np.maximum(count, 1)
            rows = batch[["key", "copies", "unit"]]
            for b in np.unique(own):
                gap = np.maximum(0, np.maximum(low - high[b], low[b] - high))
                held = rows[own == b]
                for other in np.flatnonzero((gap**2).sum(axis=1) <= reach).tolist():
                    yield held.assign(i=min(b, other), j=max(b, other), side=int(other < b))

    paired = turned.select("key", "copies", "unit", "cell").mapInPandas(place, "key bigint, copies bigint, unit binary, i int, j int, side int")
    return paired.groupBy("i", "j").applyInPandas(_block_pair(threshold), "a bigint, b bigint, n bigint")


@job
def near_duplicate_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding)."""
    rows = vectors.select(F.col("vec_id").cast("string").alias("id"), "embedding")
    read = rows.mapInPandas(_units, "id string, key bigint, dim int, unit binary")
    read = stored(read.withColumn("vec_id", F.col("id").cast("bigint")).drop("id"), "units")
    classes = read.where("dim > 0").groupBy("dim", "key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("unit").alias("unit"))
    classes = stored(classes, "classes")
    found = vectors.sparkSession.createDataFrame([], "a bigint, b bigint, n bigint")
    for (dim,) in sorted(classes.select("dim").distinct().collect()):  # lengths of vectors: one, as a rule
        found = found.union(_blocks(classes.where(F.col("dim") == dim), dim, threshold))
    found = stored(found, "links")
    links = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("others"))
    roots = components(found.where("b is not null"), "a", "b").select(F.col("node").alias("key"), "root")
    named = classes.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    names = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(names, "root").join(links, "key", "left").select("key", "dim", "component", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = read.select("vec_id", "key", "dim").join(named, ["key", "dim"], "left")
    component = F.when(F.col("dim") > 0, F.col("component")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def op9_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


OP9_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}
), reach AS (
  SELECT vec_id, vec_id AS r FROM embeddings UNION SELECT vec_id, b FROM reach JOIN links ON a = r
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(r)::BIGINT AS component_id, vec_id = min(r) AS kept
FROM reach LEFT JOIN n ON a = vec_id GROUP BY vec_id
"""

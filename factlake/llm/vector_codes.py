"""Vector codes: parts of vectors as indexes into codebooks, learnt and applied in whole numbers.

Components become integers, vectors are cut into PARTS equal parts, and parts and codebook entries are
padded with zeros to a power of two and turned by a Walsh-Hadamard transform, whose rows stand in order
of sequency (sign changes). The transform of m rows is orthogonal but for the factor m, so the squared
differences of two transforms add up to m times the squared distance, and after any number of rows
their sum bounds it from below. The leading rows are summed up for all entries; the entry that looks
best then is finished, and entries that already exceed it drop out, rows by rows, until few are left.
All of it is integer arithmetic, so elimination is exact and ties are ties.

A round is one pass over the vectors: tasks assign their vectors and return a sum and a count for each
entry, which Spark adds up by entry. The driver holds the codebooks alone, ENTRIES entries a part.

Defined results: rows with a null vector or with null or non-finite components are left out; vectors
shorter than the longest, and one whose length PARTS does not divide, are padded with zeros at the end.
Rows that share a vec_id are vectors of their own, in the order of their components; null vec_ids come
last. Tables of fewer rows than ENTRIES have codebooks of so many entries; empty ones give no rows. Whole
numbers too large for 64 bits are worked out as Python's; an error of 2^63 or more is null, and a label's
sum over such an error too. Only the three columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import job, small, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows of the transform between eliminations: while all entries are compared as a block, and pair by pair,
#: which pays when at most one in SPARSE is left.
LEADING, STEP, SPARSE = 4, 4, 10
#: Vectors that a task compares at once; component times padded length up to which all sums fit 64 bits; bits of
#: a digit of a sum.
BLOCK, SAFE, LIMB = 256, 1 << 30, 40


def transform_rows(size: int) -> np.ndarray:
    """The Walsh-Hadamard matrix of a power of two, its rows by their number of sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[np.argsort((h[:, 1:] != h[:, :-1]).sum(axis=1), kind="stable")]


def _padded(width: int) -> int:
    return 1 << max(0, width - 1).bit_length()


def _fits(x: np.ndarray) -> bool:
    """Whether no sum of squared differences of such numbers' transforms can leave 64 bits."""
    return not x.size or max(-x.min(), x.max()) * _padded(x.shape[-1]) < SAFE


def _transformed(x: np.ndarray) -> np.ndarray:
    """(n, width) to (n, m): padded to a power of two and turned."""
    m = _padded(x.shape[1])
    padded = np.zeros((len(x), m), x.dtype)
    padded[:, : x.shape[1]] = x
    return padded @ transform_rows(m).T


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The index of each part's nearest entry, the lowest of equals, its squared distance, and how
    many squared differences were worked out (all of them would be parts x entries x rows)."""
    x, c = _transformed(parts), _transformed(entries)
    if x.dtype != c.dtype:
        x, c = x.astype(object), c.astype(object)
    n, m = x.shape
    columns = np.ascontiguousarray(c.T)
    index, distance, work = np.zeros(n, np.int64), np.zeros(n, x.dtype), 0
    for at in range(0, n, BLOCK):
        v = x[at : at + BLOCK]
        partial, d = np.zeros((len(v), len(c)), x.dtype), np.empty((len(v), len(c)), x.dtype)
        k, best = 0, None
        while k < m:  # all entries, as long as most of them can still be nearest
            for j in range(k, min(k + LEADING, m)):
                np.subtract(v[:, j, None], columns[j], out=d)
                partial += np.multiply(d, d, out=d)
            work, k = work + partial.size * (min(k + LEADING, m) - k), min(k + LEADING, m)
            first = partial.argmin(axis=1)  # what looks best so far is finished: no entry beyond it is nearest
            rest = v[:, k:] - c[first, k:]
            bound = partial[np.arange(len(v)), first] + (rest * rest).sum(axis=1)
            best = bound if best is None else np.minimum(best, bound)
            near = partial <= best[:, None]
            if SPARSE * np.count_nonzero(near) <= near.size:
                break
        row, entry = np.nonzero(near)
        total = partial[row, entry]
        for k in range(k, m, STEP):  # the few that are left, pair by pair
            d = v[row, k : k + STEP] - c[entry, k : k + STEP]
            work += d.size
            total = total + (d * d).sum(axis=1)
            stay = total <= best[row]
            row, entry, total = row[stay], entry[stay], total[stay]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])  # every row keeps its first entry at least
        least = np.minimum.reduceat(total, starts)
        hit = np.flatnonzero(total == np.repeat(least, np.diff(np.r_[starts, len(row)])))
        hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]  # entries ascend within a row
        index[at : at + BLOCK], distance[at : at + BLOCK] = entry[hit], least // m
    return index, distance, work


def _whole(vectors: list, width: int) -> np.ndarray:
    """(n, PARTS, width) whole numbers of vectors of doubles: int64 where nothing made of them can
    overflow, else Python's."""
    flat = np.zeros((len(vectors), PARTS * width))
    for i, v in enumerate(vectors):
        flat[i, : len(v)] = v
    if _fits(flat.reshape(-1, width) * float(SCALE)):
        whole = np.floor(flat * SCALE).astype(np.int64)
    else:  # a double is a whole number over a power of two, so this is exact
        whole = np.array([(SCALE * a) // b for a, b in (v.as_integer_ratio() for v in flat.ravel().tolist())], object)
    return whole.reshape(len(vectors), PARTS, width)


def kept(rows: DataFrame) -> DataFrame:
    """vec_id, label, vector (doubles) of the rows that count."""
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    doubles = rows.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    return doubles.where(F.col("vector").isNotNull() & finite)


def _limbs(total: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as digits to the base 2**LIMB, the lowest first; the highest carries the sign."""
    out = []
    while (total >= 1 << LIMB).any() or (total < -1 << LIMB).any():
        out.append(total & ((1 << LIMB) - 1))
        total = total >> LIMB
    return [*out, total]


def _sums(books: list[np.ndarray], width: int):
    """Of each entry that a vector's part is nearest to, its components' sums in limbs, and at place -1 the count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in books]
        for batch in batches:
            ints = _whole(_vectors(batch.column(0)), width)
            if not len(ints):
                continue
            for p, (total, count) in enumerate(totals):
                if ints.dtype == object and total.dtype != object:
                    totals[p] = total, count = total.astype(object), count
                index, _, _ = nearest(ints[:, p], books[p])
                order = np.argsort(index, kind="stable")
                starts = np.flatnonzero(np.r_[True, index[order][1:] != index[order][:-1]])
                total[index[order][starts]] += np.add.reduceat(ints[order, p], starts, axis=0)
                count += np.bincount(index, minlength=len(count))
        for p, (total, count) in enumerate(totals):
            used = np.flatnonzero(count)
            digits = [(-1, 0, used, count[used])] + [(i, k, used, x) for i in range(width) for k, x in enumerate(_limbs(total[used, i]))]
            columns = [np.concatenate([np.broadcast_to(d[c], len(used)) for d in digits]) for c in range(4)]
            arrays = [pa.array([p] * len(columns[0]), pa.int32())] + [pa.array(columns[c].astype(np.int64), t) for c, t in ((2, pa.int32()), (0, pa.int32()), (1, pa.int32()), (3, pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "entry", "place", "limb", "s"])

    return run


def _vectors(column: pa.Array) -> list:
    """Each list of an Arrow column as a numpy array."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum([len(x) for x in column]) if len(column) else []
    return np.split(values, ends[:-1]) if len(ends) else []


def fit(vectors: DataFrame) -> list[np.ndarray]:
    """The codebooks, one a part, of kept() vectors: begun with the least vec_ids, and moved ROUNDS times
    to the floors of the means of what is nearest to them; entries that nothing is nearest to stay."""
    longest = vectors.agg(F.max(F.size("vector"))).first()[0]
    width = -(-(longest or 0) // PARTS) or 1
    first = vectors.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).collect()  # ENTRIES rows at most
    if not first:
        return []
    start = _whole([np.array(r.vector, np.float64) for r in first], width)
    books = [start[:, p] for p in range(PARTS)]
    for _ in range(ROUNDS):
        sums = vectors.select("vector").mapInArrow(_sums(books, width), "part int, entry int, place int, limb int, s bigint")
        count, total = {}, [np.zeros(b.shape, object) for b in books]
        for r in sums.groupBy("part", "entry", "place", "limb").agg(F.sum("s").alias("s")).collect():  # the size of the codebooks
            if r.place < 0:
                count[r.part, r.entry] = r.s
            else:
                total[r.part][r.entry, r.place] += r.s << (LIMB * r.limb)
        moved = [b.astype(object) for b in books]
        for (p, e), n in count.items():
            moved[p][e] = total[p][e] // n
        books = [b.astype(np.int64) if _fits(b) else b for b in moved]
    return books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of kept() vectors under these codebooks."""
    width = books[0].shape[1] if books else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ints = _whole(_vectors(batch.column("vector")), width)
            found = [nearest(ints[:, p], books[p])[:2] for p in range(PARTS)]
            code = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            error = sum(d.astype(object) for _, d in found)
            whole = [int(e) if e < 1 << 63 else None for e in error]
            rows = {"vec_id": batch.column("vec_id"), "label": batch.column("label"), "code": pa.array([c.tobytes().hex() for c in code], pa.string()), "error": pa.array(whole, pa.int64())}
            yield pa.RecordBatch.from_pydict(rows)

    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    return vectors.select("vec_id", "label", "vector").mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error bigint")


@job
def compressed(rows: DataFrame) -> DataFrame:
    """rows (vec_id, embedding, label) to vec_id, label, code, error and codebooks_sha256."""
    vectors = stored(kept(rows), "vectors")
    books = fit(vectors)
    return encode(vectors, books).withColumn("codebooks_sha256", F.lit(digest(books)))


def with_label_error(codes: DataFrame) -> DataFrame:
    """codes with the sum of the errors of each label: summed before the shuffle, and met by a broadcast
    if labels are few; else the join splits hot labels. A sum that is no longer a long is null."""
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    whole = F.when((F.count("error") == F.count("*")) & (total < F.lit(2**63 - 1).cast("decimal(38,0)") + 1), total.cast("bigint"))
    sums = stored(codes.groupBy("label").agg(whole.alias("label_error")).withColumnRenamed("label", "_label"), "label-errors")
    return codes.join(small(sums), F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = compressed(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _round_sql(k: int) -> str:
    """Assignment k of all parts to codebook k, and what becomes of the codebook."""
    return f"""
d{k} AS MATERIALIZED (
  SELECT x.vec_id, x.p, x.v, b.e, list_sum(list_transform(list_zip(x.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM parts x JOIN b{k} b ON x.p = b.p),
a{k} AS MATERIALIZED (SELECT vec_id, p, any_value(v) AS v, arg_min(e, (d, e)) AS e, min(d) AS d FROM d{k} GROUP BY vec_id, p)"""


def _moved_sql(k: int) -> str:
    return f"""
m{k} AS (SELECT p, e, i, floor_div(sum(c)::BIGINT, count(*)) AS c
  FROM (SELECT p, e, generate_subscripts(v, 1) AS i, unnest(v) AS c FROM a{k}) GROUP BY p, e, i),
l{k} AS (SELECT p, e, list(c ORDER BY i) AS v FROM m{k} GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(l.v, b.v) AS v FROM b{k} b LEFT JOIN l{k} l ON b.p = l.p AND b.e = l.e)"""


OP13_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, p, list_slice(v, p * len(v) // {PARTS} + 1, (p + 1) * len(v) // {PARTS}) AS v
  FROM kept, range({PARTS}) AS r(p)),
b0 AS MATERIALIZED (
  SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::BIGINT AS e, v FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
{",".join(_round_sql(k) + "," + _moved_sql(k) for k in range(ROUNDS))},
{_round_sql(ROUNDS)},
sha AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS}),
codes AS (SELECT vec_id, string_agg(lower(printf('%02x', e)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT c.vec_id, code, error, (sum(error) OVER (PARTITION BY k.label))::BIGINT AS label_error, codebooks_sha256
FROM codes c JOIN kept k ON c.vec_id = k.vec_id, sha
""".replace("floor_div(sum(c)::BIGINT, count(*))", "((sum(c)::BIGINT - (((sum(c)::BIGINT % count(*)) + count(*)) % count(*))) // count(*))")

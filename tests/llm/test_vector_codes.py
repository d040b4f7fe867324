import hashlib
import math

import numpy as np
import pytest

from factlake.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, entries=V.ENTRIES):
    """One vector after another, in Python's whole numbers. rows: (vec_id, vector, label)."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // 4))
    ints = []
    for _, v, _ in kept:
        whole = [math.floor(1024 * a / b) if abs(a / b) < 1e300 else 1024 * a // b for a, b in (float(x).as_integer_ratio() for x in v)]
        whole += [0] * (4 * width - len(whole))
        ints.append([whole[p * width : (p + 1) * width] for p in range(4)])
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    books = [[ints[i][p] for i in order] for p in range(4)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda v, book: min((square(v, c), e) for e, c in enumerate(book))
    for _ in range(4):
        for p in range(4):
            near = [best(v[p], books[p])[1] for v in ints]
            for e in set(near):
                mine = [v[p] for v, n in zip(ints, near, strict=True) if n == e]
                books[p][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    found = [[best(v[p], books[p]) for p in range(4)] for v in ints]
    errors = [sum(d for d, _ in f) for f in found]
    total = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        total[label] = total.get(label, 0) + e
    long = lambda x: x if x < 2**63 else None
    return sorted((repr(i), "".join(f"{e:02x}" for _, e in f), long(e), long(total[label]), sha) for (i, _, label), f, e in zip(kept, found, errors, strict=True))


def ran(spark, rows, schema=SCHEMA):
    frame = spark.createDataFrame(rows, schema)
    out = V.with_label_error(V.compressed(frame)).collect()
    return sorted((repr(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in out)


@pytest.mark.parametrize("size", [1, 2, 4, 16, 32])
def test_transform_is_orthogonal_and_in_sequency_order(size):
    h = V.transform_rows(size)
    assert (h @ h.T == size * np.eye(size, dtype=int)).all()
    assert [(r[1:] != r[:-1]).sum() for r in h] == list(range(size))


@pytest.mark.parametrize("spread", [1, 3, 300])
def test_nearest_is_exact_and_drops_entries(spread):
    rng = np.random.default_rng(spread)
    x = np.cumsum(rng.integers(-spread, spread + 1, (700, 13)), axis=1)
    c = x[rng.integers(0, 700, 90)]  # repeated entries: ties
    index, distance, work = V.nearest(x, c)
    every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert work < 700 * 90 * 16
    big = V.nearest(x.astype(object) * 10**30, c.astype(object) * 10**30)
    assert (big[0] == index).all() and (big[1] == distance.astype(object) * 10**60).all()


def test_against_plain_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.normal(size=12)], int(i % 3) if i % 5 else None) for i in rng.permutation(330)]
    assert ran(spark, rows) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 1), (2, [], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (6, [-0.0, 0.5, -0.0001], None),
        (6, [0.25] * 9, None), (6, [0.25] * 9, 2), (None, [1.0, -1.0], 2), (None, [1.0, -1.0], 2), (-7, [3.0, 2.0, 1.0, 0.0, 5.0], 2),
    ]
    got = ran(spark, rows)
    assert got == plain(rows)
    assert len(got) == 7


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [x, -x, x / 3, 1.0], i % 2) for i, x in enumerate([1e300, 2e300, 1e20, 1e9, 7.0, 3e15, -1e300, 1e300] + [float(i) for i in range(300)])]
    assert ran(spark, rows) == plain(rows)


def test_sums_in_digits():
    total = np.array([5, -5, 1 << 50, -(1 << 90), (1 << 120) + 3], object)
    digits = V._limbs(total)
    assert all(sum(int(d[i]) << (V.LIMB * k) for k, d in enumerate(digits)) == v for i, v in enumerate(total))
    assert all(-(1 << V.LIMB) <= d.min() and d.max() <= 1 << V.LIMB for d in digits)


def test_empty_and_clashing_columns(spark):
    assert ran(spark, []) == []
    rows = [(1, [1.0, 2.0, 3.0, 4.0], 1, "x", 5), (2, [1.0, 2.0, 3.0, 4.5], 1, "y", 6)]
    got = ran(spark, rows, SCHEMA + ", code string, vector int")
    assert got == plain([r[:3] for r in rows])


def test_partitions_do_not_matter(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    one, many = (sorted(map(tuple, V.compressed(rows.repartition(n)).collect())) for n in (1, 7))
    assert one == many

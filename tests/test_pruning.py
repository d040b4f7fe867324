"""Top-k by bounds against looking at everything, and how much was looked at."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.operators import cells, impacts, retrieval

SCHEMA = "vec_id long, embedding array<double>, label string"


def brute(rows, queries, k, group):
    out = {}
    good = lambda v: v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
    unit = lambda v: np.array(v) / np.abs(v).max() / np.linalg.norm(np.array(v) / np.abs(v).max())
    for q, v, g in queries:
        if good(v):
            hits = [(-round(float(unit(v) @ unit(w)), 6), i) for i, w, h in rows if good(w) and len(w) == len(v) and i != q and (not group or g == h)]
            out[q] = [i for _, i in sorted(hits)[:k]]
    return out


def found(spark, rows, queries, k, group=None, centres=None):
    frame = spark.createDataFrame(rows, SCHEMA)
    best, report = cells.search(cells.build(frame, group=group, centres=centres), spark.createDataFrame(queries, SCHEMA), k, group=group)
    out = {}
    for r in best.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.vec_id)
    return out, report


@pytest.mark.parametrize("group", [None, "label"])
def test_cells_lose_no_neighbour_and_spare_work(spark, group):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 8))
    rows = [(i, [float(x) for x in middle[i % 12] + 0.15 * rng.normal(size=8)], "ab"[i % 2]) for i in range(600)]
    rows += [(600 + i, rows[0][1], "a") for i in range(30)]  # more copies than k
    queries = rows[::20]
    got, report = found(spark, rows, queries, 5, group)
    assert got == brute(rows, queries, 5, group)
    total = report.agg(F.sum("members").alias("all"), F.sum("compared").alias("some")).first()
    assert total["some"] < total["all"] / 2


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], "a"), (2, [0.0, 0.0], "a"), (3, None, "a"), (4, [], "a"), (5, [nan, 1.0], "a"), (6, [inf, 1.0], "a"), (7, [None, 1.0], "a"), (8, [1e300, 1e300], None), (9, [1e-300, 0.0], "b"), (10, [1.0, 2.0, 3.0], "a"), (11, [3.0, 2.0, 1.0], "a")]
    for group in (None, "label"):
        got, _ = found(spark, rows, rows, 3, group)
        assert got == {q: b for q, b in brute(rows, rows, 3, group).items() if b}
    assert found(spark, [], rows, 3)[0] == {} and found(spark, rows, [], 3)[0] == {}


def texts(seed, n):
    rng = random.Random(seed)
    rare = [f"w{i}" for i in range(400)]
    return [(i, " ".join(["the"] * rng.randint(0, 4) + ["of"] * rng.randint(0, 3) + rng.choices(rare, [1 / (1 + k) for k in range(400)], k=rng.randint(0, 60))) or None, "ab"[i % 2]) for i in range(n)]


@pytest.mark.parametrize("group", [None, "lang"])
def test_bm25_bounds_lose_no_hit_and_spare_postings(spark, group, monkeypatch):
    monkeypatch.setattr(impacts, "FIRST", 40)
    docs = spark.createDataFrame(texts(1, 800), "doc_id long, text string, lang string")
    asked = [(i, f"the of the w{i * 7 % 400} w{i * 11 % 400} w{i % 5}", "ab"[i % 2]) for i in range(40)] + [(90, "", "a"), (91, None, "a"), (92, "nothing here", "a"), (93, "the", "b"), (94, "the of", "a")]
    queries = spark.createDataFrame(asked, "qid long, text string, lang string")
    plain = retrieval.bm25(docs, queries, group).withColumn("score", F.round("score", 5))
    want = retrieval.top(plain, 10, "qid", "score", "doc_id", "rank").select("qid", "doc_id", "score", "rank")
    best, report = impacts.bm25_top(impacts.impacts(docs, group), queries, 10, group)
    assert sorted(map(tuple, best.select("qid", "doc_id", "score", "rank").collect())) == sorted(map(tuple, want.collect()))
    total = report.where("qid < 40").agg(F.sum("postings").alias("all"), F.sum("read").alias("read"), F.sum("looked_up").alias("looked")).first()
    assert total["read"] + total["looked"] < total["all"]

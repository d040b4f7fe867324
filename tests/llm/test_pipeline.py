import os
import random

import pytest

import corpus_pipeline
from factlake.llm import common, shingle_join
from factlake.llm.common import stored, table

from .test_other_operators import plain_lines, plain_quality


def test_stages(spark, sf):
    """Each stage on its predecessor's rows, against plain versions of what it decides."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "shingle join", "mixing", "packing"]

    good = stored(stages["quality rules"](spark, docs, sf), "t")
    kept = {r.doc_id for r in good.collect()}
    base = {r.doc_id for r in docs.collect() if (q := plain_quality(r.text))[0] >= 50 and 100 * q[4] <= 50 * q[0]}
    assert kept <= base and len(kept) > 0.9 * len(base)
    clean = {r.doc_id for r in table(spark, sf, "labels", "doc_id", "quality").collect() if r.quality == 1}
    assert kept >= base & clean

    lines = stored(stages["line dedup"](spark, good, sf), "t")
    before = {r.doc_id: r.text for r in good.collect()}
    want = {k: (n, gone) for k, n, gone, _ in plain_lines(list(before.items()))}
    after = {r.doc_id: r for r in lines.collect()}
    assert all(r.text.count("\n") + 1 == want[k][0] - want[k][1] for k, r in after.items())
    assert all(want[k][1] for k in before.keys() - after.keys())
    assert all(r.n_chars == len(r.text) for r in after.values())

    single = stored(stages["shingle join"](spark, lines, sf), "t")
    assert {r.doc_id for r in single.collect()} == {r.doc_id for r in shingle_join.near_duplicates(lines).collect() if r.doc_id == r.component_id}

    mixed = stored(stages["mixing"](spark, single, sf), "t")
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in single.collect()}
    assert good.columns == lines.columns == single.columns == mixed.columns == columns

    pieces = stages["packing"](spark, mixed, sf).collect()
    assert {p.doc_id for p in pieces} == {r.doc_id for r in mixed.collect()}
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert corpus_pipeline.run(spark, sf).count() > 0


def odd_documents():
    """Nulls in every column, repeated rows, ties, empty and long texts, copies, and clashing names."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    prose = lambda n: ". ".join(" ".join(word() for _ in range(12)) for _ in range(n // 12))
    shared = "a line that very many of these documents hold, word for word"
    texts = [prose(120) for _ in range(30)] + [f"{prose(100)}\n{shared}\n{prose(60)}" for _ in range(20)]
    copies = [texts[0]] * 15 + [texts[1] + " end"] * 4 + [texts[2].upper()]
    rows = [(i, t, "en", "web", len(t), "x", i % 3, 7) for i, t in enumerate(texts + copies)]
    rows += [(900, None, "en", "web", None, None, None, None), (901, "", None, None, 0, "y", 1, 1), (902, " \n\t\n", "en", "web", 4, "y", 1, 1), (903, "too short", "en", None, 9, "y", 1, 1)]
    long = prose(60_000)
    rows += [(904, long, "en", "books", len(long), "z", 2, 2), (None, prose(90), "en", "web", 1, "n", 1, 1), (None, None, None, None, None, None, None, None)]
    return rows + [rows[3], rows[3], (5, prose(80), "en", "web", 1, "tie", 0, 0), (6, prose(80), None, None, None, None, None, None)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, `_row` string, `a.b` int, n_words int"


@pytest.mark.parametrize("rows", [odd_documents(), []], ids=["odd", "empty"])
def test_odd_documents(spark, tmp_path, rows):
    sf = f"file://{tmp_path}"
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(0, 1), (1, 1), (None, None), (900, 0)] if rows else [], "doc_id bigint, quality int").write.parquet(f"{sf}/labels.parquet")
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "t")
        seen[name] = [tuple(r) for r in docs.collect()]
        if name != "packing":
            assert docs.columns == spark.read.parquet(f"{sf}/documents.parquet").columns
    long_enough = lambda t: len((t or "").split()) >= 50
    assert sorted(map(repr, seen["quality rules"])) == sorted(repr(r) for r in rows if long_enough(r[1]))
    # of sixteen and of four equal documents of one line the last one stays; other documents keep a line at least
    assert len(seen["line dedup"]) == len(seen["quality rules"]) - (18 if rows else 0)
    texts = [r[1] for r in seen["shingle join"]]
    plain = {t.lower() for t in texts}
    assert len(plain) == len([t for t, r in zip(texts, seen["shingle join"], strict=True) if r[0] is not None]) + sum(r[0] is None for r in seen["shingle join"])
    copies = {}
    for r in seen["mixing"]:
        copies[r] = copies.get(r, 0) + 1
    assert set(copies) == set(seen["shingle join"]) and all(1 <= n <= corpus_pipeline.REPEATS for n in copies.values())
    assert sum(p[2] for p in seen["packing"]) == sum(p[4] for p in seen["packing"] if p[1] == 0)
    assert len([p for p in seen["packing"] if p[1] == 0]) == len(seen["mixing"])
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(seen["packing"])


def test_a_run_leaves_only_its_result(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "scratch", lambda spark: f"file://{tmp_path}/shared")
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0
    assert os.listdir(f"{tmp_path}/shared") == [os.path.basename(out.__dict__["_stored_at"])]

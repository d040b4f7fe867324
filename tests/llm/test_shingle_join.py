import random
from collections import defaultdict

import numpy as np
import pytest

from factlake.llm import common
from factlake.llm import shingle_join as S


def plain_sets(rows):
    out = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def plain_components(rows):
    """Every pair, by the definition."""
    sets, root = plain_sets(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    names = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        names[find(i)].append(k)
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in names.items()}
    return sorted((-1 if k is None else k, len(sets[i]), least[find(i)] if sets[i] else k) for i, (k, _) in enumerate(rows))


def made(seed, groups, loners, common):
    """Texts with exact and near copies around the threshold, and passages that many share."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 6)))
    passages = [[word() for _ in range(30)] for _ in range(3)]
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(r.randint(3, 120))]
        for _ in range(r.choice([2, 2, 3, 8, 40])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 40))):
                copy[r.randrange(len(copy))] = word()
            rows.append(" ".join(copy).upper() if r.random() < 0.1 else "\n ".join(copy))
    for _ in range(loners):
        rows.append(" ".join(word() for _ in range(r.randint(1, 80))))
    for _ in range(common):
        rows.append(" ".join(r.choice(passages) + r.choice(passages) + [word() for _ in range(r.randint(0, 12))]))
    r.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed, block, frequent", [(1, 256, 24), (2, 8, 3)])
def test_against_all_pairs(spark, monkeypatch, seed, block, frequent):
    """The second case makes groups larger than blocks, and most shingles frequent."""
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "FREQUENT", frequent)
    rows = made(seed, 25, 40, 90) + [(None, None), (1, ""), (2, " \n"), (4, "one"), (5, "ONE"), (5, "one two three four"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6).selectExpr("*", "'x' as key", "1 as n")
    got = S.near_duplicates(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows)


def test_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "other"), (None, "a b c d e f"), (9, None)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, hash int")
    assert sorted((r.doc_id or 0, r.hash) for r in S.one_of_each(docs).collect()) == [(0, 7), (1, 7), (3, 7), (9, 7)]


def test_rows_that_share_an_id_are_judged_one_by_one(spark):
    """A text of its own stays whatever copies share its id; of equal rows one stays."""
    a, z = "a b c d e f", "v w x y z unlike all others"
    rows = [(3, a, "p"), (5, a, "q"), (5, z, "r"), (8, None, "s"), (8, None, "s"), (9, "k l m n o p", "t"), (9, "k l m n o p", "u"), (9, "k l m n o p", "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `a.b` string").selectExpr("*", "1 as _row", "2 as doc", "3 as mark", "4 as best")
    got = S.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == [(3, a), (5, z), (8, ""), (8, ""), (9, "k l m n o p")]
    same = S.one_of_each(spark.createDataFrame([(3, a)] * 3, "doc_id bigint, text string"))
    assert [tuple(r) for r in same.collect()] == [(3, a)]
    assert S.one_of_each(docs.limit(0)).count() == 0


def test_settings_and_tables_stay_as_they_were(spark, tmp_path, monkeypatch):
    """An operator gives the session its settings back, and leaves its result alone in the folder."""
    keys = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Bytes", "Records")]
    before = [spark.conf.get(k) for k in keys]
    monkeypatch.setattr(common, "scratch", lambda _: f"file://{tmp_path}")
    out = S.near_duplicates(spark.createDataFrame(made(3, 4, 4, 4), "doc_id bigint, text string"))
    assert out.count() > 0
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 1
    assert [spark.conf.get(k) for k in keys] == before


def test_block_product_in_slabs(monkeypatch):
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 200, n).astype(np.uint64)) for n in (150, 160, 170, 5, 180)]
    sets.append(sets[0][:-3])
    want = [[100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b)) for b in map(set, sets)] for a in map(set, sets)]
    for slab in (8192, 7):
        monkeypatch.setattr(S, "SLAB", slab)
        assert S.block_links(sets).tolist() == want


def test_empty_and_long(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.near_duplicates(docs).count() == 0
    long = " ".join(f"w{i}" for i in range(30_000))
    got = S.near_duplicates(spark.createDataFrame([(1, long), (2, long + " end"), (3, long[: len(long) // 2])], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3)]


def test_templates_of_many_documents(spark, monkeypatch):
    """Documents of one template with own endings form one large group. Few link: some by endings that two or
    three share, some because they are short, so that the template alone is enough; all of these are found."""
    monkeypatch.setattr(S, "BLOCK", 16)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(164)]
    texts = []
    for i in range(150):
        own = [f"o{i}x{k}" for k in range(rng.choice([31, 31, 31, 33, 36, 40, 12, 60]))]
        texts.append(base + own)
        if i % 5 == 0:
            texts.append(base + own[: rng.randint(8, 31)] + [f"q{i}x{k}" for k in range(rng.randint(0, 20))])
        if i % 7 == 0:
            texts.append(base[: rng.randint(120, 160)] + own)
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows)
    assert 20 < len({r.component_id for r in got}) < len(rows) - 20

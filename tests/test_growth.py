"""Plans that hold when tables grow: what is broadcast, what is shuffled, what a task holds."""

import io
import random
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from factlake.operators import aliases, cells, chunking, impacts, retrieval, routing, terms
from factlake.plans import text_queries

from .test_pruning import brute


def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def files(spark, tmp_path, rows, schema, name):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}")
    return spark.read.parquet(f"{tmp_path}/{name}")


def test_words_of_texts_are_not_broadcast(spark, tmp_path):
    """The texts are the smaller table as files; their words are not."""
    texts = files(spark, tmp_path, [(i, "The large ring") for i in range(50)], "k long, t string", "texts")
    names = files(spark, tmp_path, [("large ring", "x" * 50), ("large", "first")], "alias string, name string", "names")
    hits = routing.longest_alias(texts, "k", F.col("t"), names.union(names))
    assert "BuildLeft" not in plan(hits) and sorted(map(tuple, hits.collect())) == [(i, "large ring", "x" * 50) for i in range(50)]


def test_grams_of_texts_are_not_broadcast(spark, tmp_path):
    texts = files(spark, tmp_path, [(i, "thelargeringofit") for i in range(50)], "k long, t string", "texts")
    names = files(spark, tmp_path, [("large", "a"), ("largering", "b"), ("ofitall", "c")], "alias string, name string", "names")
    found = aliases.longest_in(texts, "k", F.col("t"), names, most=0)
    assert "BroadcastHashJoin" not in plan(found)
    assert sorted(map(tuple, found.collect())) == [(i, "largering", "b") for i in range(50)]


def test_hits_stay_where_their_documents_are(spark, tmp_path):
    docs = files(spark, tmp_path, [(i, f"the word w{i % 7}", "en") for i in range(60)], "doc_id long, text string, lang string", "docs")
    asked = spark.createDataFrame([(1, "the w3", "en"), (2, "w5 word", "en")], "qid long, text string, lang string")
    for group in (None, "lang"):
        shuffles = [x for x in plan(retrieval.bm25(docs, asked, group)).splitlines() if "hashpartitioning(" in x]
        assert len(shuffles) == 1 and "hashpartitioning(doc_id" in shuffles[0]


def test_candidates_meet_texts_that_stay(spark, sf):
    """Texts are not shuffled to the few rows to rerank, whatever Spark takes these for."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled = [x for x in plan(text_queries.rerank_overlap(spark, sf)).splitlines() if "hashpartitioning(doc_id" in x]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not shuffled


def test_vector_products_are_few_at_once(spark, monkeypatch):
    """Parts of a cell's queries give what all of them at once give."""
    monkeypatch.setattr(cells, "PRODUCTS", cells.PRODUCTS >> 14)
    rows = [(i, [float(i % 7 + 1), float(i % 11), 1.0], "a") for i in range(300)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    best, _ = cells.search(cells.build(frame, centres=2), frame, 3)
    got = {}
    for r in best.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.vec_id)
    assert got == brute(rows, rows, 3, None)


def test_long_texts_reach_python_a_few_at_a_time(spark):
    texts = spark.createDataFrame([(i, "word " * 900) for i in range(300)], "k long, text string")
    rows = chunking.recursive_chunks(texts, "k")
    assert "MapInPandas" not in plan(rows) and "BatchEvalPython" in plan(rows)
    assert sorted(map(tuple, rows.collect())) == [(k, i, c) for k in range(300) for i, c in enumerate(chunking.split_text("word " * 900, 3000, 300))]


def test_a_dictionary_is_not_sorted_for_its_keys(spark):
    known = spark.createDataFrame([(i, f"T{i % 5}", f"T (a{i % 3}, t)", "c", f"d{i}") for i in range(60)], "ordinal long, term string, name_full string, category string, definition string")
    index = terms.keys(known)
    assert "SortAggregate" not in plan(index)
    asked = spark.createDataFrame([(1, " t4"), (2, "A2"), (3, "T"), (4, None), (5, " "), (6, "no")], "qid long, word string")
    got = {r.qid: r.definition for r in terms.lookup(asked, index).collect()}
    assert got == {1: "d59", 2: "d59", 3: "d59", 4: None, 5: None, 6: None}


def shuffled(spark):
    """Bytes that this session has written for shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


def test_the_pruned_search_keeps_postings_of_asked_terms_and_no_hits(spark, tmp_path, monkeypatch):
    """Words that no query has are neither written by document nor shuffled; a query's hits are not written."""
    docs = files(spark, tmp_path, [(i, f"the of w{i % 7} " + " ".join(f"x{i * j}" for j in range(60)), "en") for i in range(400)], "doc_id long, text string, lang string", "docs")
    queries = spark.createDataFrame([(q, f"the of w{q % 7}", "en") for q in range(30)], "qid long, text string, lang string")
    sizes, write = {}, impacts.written

    def counted(df, name):
        table = write(df, name)
        sizes[name] = table.count()
        return table

    monkeypatch.setattr(impacts, "written", counted)
    best, _ = impacts.bm25_top(impacts.impacts(docs), queries, 5)
    want = retrieval.top(retrieval.bm25(docs, queries).withColumn("score", F.round("score", 5)), 5, "qid", "score", "doc_id", "rank")
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, want.select("qid", "doc_id", "score", "rank").collect()))
    assert max(sizes.values()) == 3 * 400 and all(n <= 30 * 5 for name, n in sizes.items() if name != "postings")


def test_texts_are_not_shuffled_gram_by_gram(spark, tmp_path):
    """Beyond a dictionary to broadcast, only the parts of texts that may be aliases are shuffled."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    names = [(word(rng.randint(5, 14)), f"n{i}") for i in range(300)]
    rows = [(i, word(300) + names[i % 300][0] + word(300)) for i in range(1000)]
    texts, known = files(spark, tmp_path, rows, "k long, t string", "texts"), files(spark, tmp_path, names, "alias string, name string", "names")
    before = shuffled(spark)
    got = {r.k: len(r.alias) for r in aliases.longest_in(texts, "k", F.col("t"), known, most=0).collect()}
    assert shuffled(spark) - before < sum(len(t) for _, t in rows)
    assert got == {i: max(len(a) for a, _ in names if a in t) for i, t in rows}

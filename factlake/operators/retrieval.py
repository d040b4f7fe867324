"""Retrieval over text: BM25, vectors, fusion of rankings, relaxation of filters, rerank.

All of it answers a table of queries at once. Terms meet postings in an equality join, so nothing
pairs every query with every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.shared import small, written

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Documents of a task, about: each may be a hit of every query.
TOGETHER = 4096


def terms(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """key, term, tf of lower-case words split at white space."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return rows.select(key, F.explode(words).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def top(rows: DataFrame, k: int, by: str | list[str], score: str, key: str, rank: str) -> DataFrame:
    """The k best of each query, ranked from 1; ties by key. The ranking of a query spreads over
    tasks first where Spark can limit a window early (row_number up to k)."""
    w = Window.partitionBy(by).orderBy(F.desc(score), key)
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _counted(docs: DataFrame, group: str | None, keep: tuple[str, ...] = (), only: DataFrame | None = None) -> DataFrame:
    """doc_id, g, dl, the columns to keep, term, tf of each word of each document, or of the terms of `only`
    (g, term). Texts go to tasks by doc_id, TOGETHER at a time, so all that is grouped by document stays there."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    n = max(docs.sparkSession.sparkContext.defaultParallelism, docs.count() // TOGETHER)
    g = (F.col(group).cast("string") if group else F.lit("")).alias("g")
    rows = docs.select("doc_id", g, *keep, "text").repartition(n, "doc_id").select("doc_id", "g", *keep, words.alias("w"))
    rows = rows.select("doc_id", "g", *keep, F.size("w").alias("dl"), F.explode("w").alias("term"))
    rows = rows if only is None else rows.join(only, ["g", "term"], "left_semi")
    return rows.groupBy("doc_id", "g", "dl", *keep, "term").agg(F.count("*").alias("tf"))


def postings(docs: DataFrame, group: str | None = None) -> DataFrame:
    """The index: doc_id, g, dl, term, tf of each word of each document, written once. g: the group, one
    value for all without; dl: the document's words."""
    return written(_counted(docs, group), "postings")


def lengths(docs: DataFrame, group: str | None = None) -> DataFrame:
    """g, n_docs, avgdl of each group with words. Written, a row per group."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != "")
    g = (F.col(group).cast("string") if group else F.lit("")).alias("g")
    sizes = docs.select(g, F.size(words).alias("dl")).groupBy("g").agg(F.count("*").alias("n_docs"), F.sum("dl").alias("n_words"))
    return written(sizes.where("g is not null and n_words > 0").select("g", "n_docs", (F.col("n_words") / F.col("n_docs")).alias("avgdl")), "sizes")


def vocabulary(docs: DataFrame, group: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Each group's words (g, term, df, n_docs, avgdl, idf) and their mean (g, mean_idf). Written; terms alone
    are shuffled for it."""
    g = (F.col(group).cast("string") if group else F.lit("")).alias("g")
    sizes = small(lengths(docs, group))
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: w != ""))
    df = docs.select(g, F.explode(words).alias("term")).groupBy("g", "term").agg(F.count("*").alias("df")).join(sizes, "g")
    df = written(df.withColumn("idf", F.ln(F.col("n_docs") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)), "df")
    # the mean of logarithms is summed as whole billionths, so that it does not depend on their order
    mean = df.groupBy("g").agg((F.sum(F.round(F.col("idf") * 1e9).cast("bigint")).cast("double") / F.count("*") / 1e9).alias("mean_idf"))
    return df, written(mean, "mean")


def weighed(known: tuple[DataFrame, DataFrame], queries: DataFrame, group: str | None = None) -> DataFrame:
    """qid, qtf, g, term, df, idf, avgdl of the words of queries (qid, text and group) that documents have. Written."""
    df, mean = known
    g = (F.col(group).cast("string") if group else F.lit("")).alias("g")
    wanted = terms(queries, "qid", F.col("text")).withColumnRenamed("tf", "qtf").join(queries.select("qid", g), "qid")
    wanted = small(written(wanted, "wanted"))
    idf = F.when(F.col("idf") < 0, F.col("mean_idf") * FLOOR).otherwise(F.col("idf"))
    return written(wanted.join(df, ["g", "term"]).join(small(mean), "g").select("qid", "qtf", "g", "term", "df", idf.alias("idf"), "avgdl"), "weighed")


def bm25(docs: DataFrame, queries: DataFrame, group: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """qid, doc_id, score of every document that shares a term with a query, and the columns of it to keep.

    docs: doc_id, text (and group); queries: qid, text (and group). With a group, a query sees only
    the documents of its own, and idf and mean length are those of that group: the filter comes
    first. Negative idf is replaced by a quarter of the mean idf over the group's vocabulary.
    Terms alone are shuffled for the vocabulary. Then texts are dealt by document, their words that no query
    has are dropped, and scores are summed where the documents are.
    """
    wanted = weighed(vocabulary(docs, group), queries, group).select("qid", "qtf", "g", "term", "idf", "avgdl")
    only = small(written(wanted.select("g", "term").distinct(), "only"))
    hits = _counted(docs, group, keep, only).join(small(wanted), ["g", "term"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("qid", "doc_id", *keep).agg((F.sum(F.round(part * 1e9).cast("bigint")) / F.lit(1e9)).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int, group: str) -> DataFrame:
    """qid, vec_id, score, rank: the k nearest vectors of the query's group, itself aside.

    Queries (qid, embedding, group) are a stated set, broadcast while it is small, so that a group
    of very many vectors stays where it is; each vector's length is worked out once.
    """
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    size = lambda v: F.sqrt(dot(F.col(v), F.col(v)))
    double = F.transform("embedding", lambda x: x.cast("double"))
    q = queries.select("qid", double.alias("wanted"), group).withColumn("wanted_size", size("wanted"))
    rows = vectors.select("vec_id", double.alias("v"), group).withColumn("size", size("v"))
    rows = rows.join(small(written(q, "queries")), group).where("qid <> vec_id")
    rows = rows.select("qid", "vec_id", F.round(F.try_divide(dot(F.col("v"), F.col("wanted")), F.col("size") * F.col("wanted_size")), 6).alias("score"))
    return top(rows, k, "qid", "score", "vec_id", "rank")


def fuse(lists: list[tuple[DataFrame, float]], c: int = 0) -> DataFrame:
    """Weighted reciprocal-rank fusion: qid, key, score = sum of w / (c + rank), and the best rank
    in the first list. Lists: qid, key, rank from 1."""
    all_lists = None
    for i, (rows, weight) in enumerate(lists):
        part = rows.select("qid", "key", (F.lit(weight) / (F.col("rank") + c)).alias("part"), F.when(F.lit(i == 0), F.col("rank")).alias("first_rank"))
        all_lists = part if all_lists is None else all_lists.unionByName(part)
    return all_lists.groupBy("qid", "key").agg(F.round(F.sum("part"), 9).alias("score"), F.min("first_rank").alias("first_rank"))


#: Filters from the strictest to none: level and the fields that it keeps.
RELAXED = ((0, ("company", "year")), (1, ("company",)), (2, ()))


def relax(hits: DataFrame) -> DataFrame:
    """The hits of the strictest level at which a query has any.

    hits: qid, level of the strictest filter that the hit passes. A hit that passes a strict filter
    passes a looser one, so the least level with hits tells it all in one window.
    """
    w = Window.partitionBy("qid")
    return hits.withColumn("applied", F.min("level").over(w)).where("level <= applied")


def overlap(query: Column, text: Column, characters: int = 1500) -> Column:
    """The default reranker: share of the query's tokens among those of the text's beginning, which
    is all that a cross-encoder would read."""
    wanted = F.array_distinct(tokens(F.lower(query)))
    return F.round(F.try_divide(F.size(F.array_intersect(wanted, tokens(F.lower(F.substring(text, 1, characters))))), F.size(wanted)), 6)


def confidence(relaxed: Column, reranked: Column, n: Column) -> Column:
    return F.when(relaxed, "low").when(reranked & (n >= 3), "high").otherwise("medium")


def retrieve(hits: DataFrame, texts: DataFrame, queries: DataFrame, candidates: int, k: int) -> DataFrame:
    """qid, doc_id, rank, applied, confidence: the strictest filter that has hits, the best
    `candidates` of it, and of these the k best by the reranker.

    hits: qid, doc_id, score, level; texts: doc_id, text; queries: qid, text. The texts of the
    candidates alone meet the queries.
    """
    kept = relax(top(hits, candidates, ["qid", "level"], "score", "doc_id", "before"))
    found = small(written(kept.select("qid", "doc_id", "before", "applied"), "candidates"))
    both = texts.join(found, "doc_id").join(small(written(queries.select("qid", F.col("text").alias("q")), "asked")), "qid")
    both = both.select("qid", "doc_id", "before", "applied", overlap(F.col("q"), F.col("text")).alias("overlap"))
    best = top(both, k, "qid", "overlap", "before", "rank")
    n = F.count("*").over(Window.partitionBy("qid"))
    return best.select("qid", "doc_id", "rank", "applied", confidence(F.col("applied") > 0, F.lit(True), n).alias("confidence"))

"""Queries on texts, dialogues, pages and events, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import periods, text
from ..operators import aliases, cells, chunking, evaluate, impacts, retrieval, routing, session
from ..sources.facts import read
from ..sources.shared import small, written
from ..streaming.sessions import stream_session_control, stream_session_state

BLOCKED = ("Licensed", "copyright", "Cookie")
ENTITIES = [("mentent", "A"), ("tion", "B"), ("ung", "C"), ("que", "D"), ("ción", "E"), ("heit", "F")]
NOW = "2024-01-31 00:00:00"
K = 10


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections: long enough, and without a blocked word in their first line."""
    title = F.substring_index("text", "\n", 1)
    return read(spark, sf_dir, "documents").where((F.length("text") >= 100) & ~title.rlike("|".join(BLOCKED)))


def doc_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = text.headed(F.col("source"), F.col("lang"), F.col("text"))
    return sections(spark, sf_dir).select("doc_id", F.length("text").cast("bigint").alias("char_count"), F.md5(body.cast("binary")).alias("headed_md5"), F.md5(text.unheaded(body).cast("binary")).alias("text_md5"))


def chunk_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.stride_chunks(sections(spark, sf_dir), "doc_id", 1000, 100)
    return rows.select("doc_id", "chunk_idx", F.length("chunk").alias("n"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"))


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive_chunks(sections(spark, sf_dir), "doc_id")


def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sections(spark, sf_dir).select("source", F.greatest(F.ceil((F.length("text") - 100) / F.lit(900)), F.lit(1)).cast("bigint").alias("n"))
    return rows.groupBy("source").agg(F.sum("n").alias("n_chunks"), F.count("*").alias("n_sections"), F.round(F.sum("n").cast("double") / F.count("*"), 4).alias("mean_chunks"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.element_at(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]), (F.col("item_id") % 4 + 1).cast("int"))
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text", lang.alias("lang"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def _lexical(spark, sf_dir, group=None, k=K) -> DataFrame:
    hits = retrieval.bm25(_docs(spark, sf_dir), _queries(spark, sf_dir), group)
    return retrieval.top(hits.withColumn("score", F.round("score", 5)), k, "qid", "score", "doc_id", "rank")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir).select("qid", "doc_id", "score", "rank")


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, "lang").select("qid", "doc_id", "score", "rank")


def _nearest(spark, sf_dir) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    q = e.join(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return retrieval.vector_topk(e, q.select(F.col("vec_id").alias("qid"), "embedding", "label"), K, "label")


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nearest(spark, sf_dir).select("qid", "vec_id", "score", "rank")


def bm25_topk_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bm25_topk by bounds of terms and blocks."""
    best, _ = impacts.bm25_top(impacts.impacts(_docs(spark, sf_dir)), _queries(spark, sf_dir), K)
    return best


def vector_topk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every twentieth vector the ten nearest of all, by cells."""
    e = read(spark, sf_dir, "embeddings")
    best, _ = cells.search(cells.build(e), e.where("vec_id % 20 = 0"), K)
    return best


def _fused(weights, c):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        a = _lexical(spark, sf_dir).withColumnRenamed("doc_id", "key")
        b = _nearest(spark, sf_dir).withColumnRenamed("vec_id", "key")
        rows = retrieval.fuse([(a, weights[0]), (b, weights[1])], c).withColumn("tie", F.coalesce("first_rank", F.lit(1000)).cast("bigint") * 10**9 + F.col("key"))
        return retrieval.top(rows, K, "qid", "score", "tie", "rank").select("qid", F.col("key").alias("doc_id"), "score", "rank")

    return query


def _levelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every BM25 hit with the strictest filter that it passes: source and language, source, none."""
    q = _queries(spark, sf_dir).select("qid", F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")).alias("q_source"), F.col("lang").alias("q_lang"))
    hits = retrieval.bm25(_docs(spark, sf_dir), _queries(spark, sf_dir), keep=("lang", "source")).withColumn("score", F.round("score", 5))
    hits = hits.join(small(written(q, "asked")), "qid")
    same = F.col("source") == F.col("q_source")
    return hits.withColumn("level", F.when(same & (F.col("lang") == F.col("q_lang")), 0).when(same, 1).otherwise(2))


def filter_relaxation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits under source and language, else under the source, else under nothing."""
    # every hit has its level; the best five of each level hold the best five of the least one
    kept = retrieval.relax(retrieval.top(_levelled(spark, sf_dir), 5, ["qid", "level"], "score", "doc_id", "rank"))
    n = F.count("*").over(Window.partitionBy("qid"))
    return kept.select("qid", "doc_id", "rank", "applied", retrieval.confidence(F.col("applied") > 0, F.lit(True), n).alias("confidence"))


def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters relaxed, the best ten reranked by overlap to three."""
    return retrieval.retrieve(_levelled(spark, sf_dir), _docs(spark, sf_dir).select("doc_id", "text"), _queries(spark, sf_dir), K, 3)


def rerank_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _lexical(spark, sf_dir).select("qid", "doc_id", F.col("rank").alias("before"))
    hits = hits.join(_queries(spark, sf_dir).select("qid", F.col("text").alias("q")), "qid")
    both = _docs(spark, sf_dir).select("doc_id", "text").join(small(written(hits, "candidates")), "doc_id")
    rows = both.select("qid", "doc_id", "before", retrieval.overlap(F.col("q"), F.col("text")).alias("overlap"))
    return retrieval.top(rows, 3, "qid", "overlap", "before", "rank")


# Templates of questions; {c} a company, {s} a sector, {y} a year.
TEMPLATES = [
    ("{c} Net sales {y}년 연간", "fact_lookup", "revenue", None),
    ("{c} 자산총계", "fact_lookup", "assets", None),
    ("{c} 영업이익 {y}년 2분기 전략", "hybrid", "operating_profit", None),
    ("{c} 리스크", "narrative", None, None),
    ("{c} 최근 뉴스", "news_context", None, None),
    ("ROE 뜻", "definition", None, "ROE"),
    ("{s} 업종 비교", "sector_compare", None, None),
    ("안녕", "general", None, None),
    ("{c} 전년 당기순이익 3Q", "fact_lookup", "net_profit", None),
    ("{c}", "narrative", None, None),
]
_ACCOUNTS = [("Netsales", "revenue"), ("매출액", "revenue"), ("자산총계", "assets"), ("영업이익", "operating_profit"), ("당기순이익", "net_profit"), ("순이익", "net_profit")]
_TERMS = [("ROE", "ROE"), ("ROA", "ROA"), ("PER", "PER")]


def route_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made from customers and templates, and what the router makes of them."""
    i, year = F.col("c_custkey") % 10, (F.lit(2000) + F.col("c_custkey") % 25).cast("string")
    c, s = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")), F.col("c_mktsegment")
    q = F.lit(None)
    for n, (t, *_) in enumerate(TEMPLATES):
        made = F.replace(F.replace(F.replace(F.lit(t), F.lit("{c}"), c), F.lit("{s}"), s), F.lit("{y}"), year)
        q = F.when(i == n, made).otherwise(q)
    questions = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("qid"), q.alias("text"))
    names = {
        "corp": [(f"NATION_{k}", f"NATION_{k}") for k in range(25)],
        "account": _ACCOUNTS,
        "sector": [(x, x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")],
        "term": _TERMS,
    }
    return routing.route(questions, names)


def alias_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest word of the documents that stands in a turn without its spaces, and its language."""
    word = F.explode(F.regexp_extract_all("text", F.lit("[a-zà-ÿ]{5,}"), F.lit(0)))
    known = read(spark, sf_dir, "documents").select(word.alias("alias"), "lang").groupBy("alias").agg(F.min("lang").alias("name"))
    turn = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = read(spark, sf_dir, "conversations").select(turn.alias("id"), F.replace("text", F.lit(" "), F.lit("")).alias("t"))
    return aliases.longest_in(rows, "id", F.col("t"), known)


def longest_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    aliases = part.select(F.col("p_name").alias("alias"), F.upper("p_name").alias("name")).union(part.select(F.substring_index("p_name", " ", 1), F.lit("first word"))).distinct()
    text_of = part.select("p_partkey", F.concat_ws(" ", F.lit("The"), "p_name", "p_type", "p_brand").alias("t"))
    return routing.longest_alias(text_of, "p_partkey", F.col("t"), aliases)


def _turns(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    return routing.longest_contained(rows, "conv_id", F.col("text"), ENTITIES, "entity")


def session_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.carry(_turns(spark, sf_dir), "conv_id", "turn", ["entity"]).select("conv_id", "turn", "entity", "last_entity")


def session_last5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return session.last_turns(rows, "conv_id", "turn", "role").select("conv_id", "turn", F.array_join("history", ",").alias("history"))


def session_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as questions that leave things out."""
    e = read(spark, sf_dir, "events")
    k = F.col("event_id")
    maybe = lambda every, value: F.when(k % every == 0, value)
    turns = e.select(
        F.col("user_id").alias("session"), k.cast("int").alias("turn"), maybe(3, F.concat(F.lit("C"), (k % 7).cast("string"))).alias("corp"), maybe(4, (2000 + k % 20).cast("int")).alias("year"),
        maybe(5, F.lit("revenue")).alias("account"), maybe(7, F.lit("FY")).alias("scope"), F.lit(None).cast("string").alias("statement"),
        (k % 11 == 0).alias("pronoun"), (k % 5 == 1).alias("compare"), (k % 2 == 0).alias("back"), (k % 5 == 2).alias("switch"),
    )
    return session.complete(turns)


def _sessions(gap: str):
    return lambda spark, sf_dir: session.sessions(read(spark, sf_dir, "events"), "user_id", "ts", gap)


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.cache_hits(read(spark, sf_dir, "events"), "user_id", "ts", "event_id", 6 * 3600)


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = text.flat_text(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", F.length(flat).cast("bigint").alias("n_chars"), F.md5(flat.cast("binary")).alias("text_md5"))


def url_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url", text.source_of(F.col("url")).alias("source"))


def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", periods.relative_time(F.col("ts"), F.lit(NOW).cast("timestamp_ntz")).alias("ago"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outermost braces of a reply around the props, read, and written again."""
    reply = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    k = F.from_json(text.last_json(reply), "k int")["k"]
    rows = read(spark, sf_dir, "events").select("event_type", k.alias("k"))
    return rows.groupBy("event_type").agg(F.sum("k").alias("sum_k"), F.count("k").alias("n"), F.max(F.to_json(F.struct("k"))).alias("largest"))


def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a dictionary: hits of the name, in the name, in the type, in the brand, in this order."""
    words = ("ring", "red widget", "STANDARD", "Brand#12", "e")
    p = read(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("n"), F.lower("p_type").alias("t"), F.lower("p_brand").alias("b"), F.explode(F.array(*[F.lit(w) for w in words])).alias("word"))
    w = F.lower("word")
    priority = F.when(F.col("n") == w, 0).when(F.col("n").contains(w), 1).when(F.col("t").contains(w), 2).when(F.col("b").contains(w), 3)
    hits = p.withColumn("priority", priority).where("priority is not null").withColumn("order", -F.col("priority"))
    return retrieval.top(hits, 20, "word", "order", "p_partkey", "rank").select("word", "p_partkey", "priority", "rank")


def number_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's main number stands below its first line."""
    whole, below = F.col("text"), F.regexp_replace("text", r"^[^\n]*\n?", "")
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", text.main_number(whole).alias("number"), text.number_match(whole, below).alias("ok"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' turns with the next turn and the one two after it."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("reply"), F.lead("text", 3).over(w).alias("later"))
    return rows.where("role = 'user'")


def keyword_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _questions(spark, sf_dir).select("conv_id", "turn", text.keyword_coverage(F.col("text"), F.col("reply")).alias("coverage"))


def answer_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("doc_id") % 9 == 0, "").when(F.col("doc_id") % 9 == 1, "답변 생성 중 오류가 발생했습니다: timeout").when(F.col("doc_id") % 9 == 2, "값을 찾을 수 없습니다").otherwise(F.col("text"))
    rows = read(spark, sf_dir, "documents").select(text.answer_status(answer).alias("status"), "n_chars")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.round(F.sum("n_chars").cast("double") / F.count("*"), 3).alias("mean_chars"))


def _answers(spark, sf_dir) -> DataFrame:
    """Two systems: one answers with the next turn, the other with a later one, if there is any."""
    q = _questions(spark, sf_dir)
    system = F.explode(F.array(*[F.struct(F.lit(x).alias("system"), F.col(x).alias("answer")) for x in ("reply", "later")]))
    rows = q.select(F.col("conv_id").alias("id"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("category"), F.col("text").alias("truth"), system.alias("s"))
    return rows.select("s.system", "id", "category", "truth", "s.answer")


def eval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.answer_rates(evaluate.scored(_answers(spark, sf_dir)))


def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.metric_summary(evaluate.scored(_answers(spark, sf_dir)))


QUERIES = {
    "doc_sections": doc_sections,
    "chunk_stride": chunk_stride,
    "chunk_recursive": chunk_recursive,
    "chunk_stats": chunk_stats,
    "bm25_topk": bm25_topk,
    "bm25_filtered": bm25_filtered,
    "vector_topk": vector_topk,
    "vector_topk_cells": vector_topk_cells,
    "bm25_topk_pruned": bm25_topk_pruned,
    "hybrid_fusion": _fused((0.4, 0.6), 0),
    "fusion_rrf60": _fused((0.5, 0.5), 60),
    "filter_relaxation": filter_relaxation,
    "retrieve": retrieve,
    "rerank_overlap": rerank_overlap,
    "route_intent": route_intent,
    "longest_alias": longest_alias,
    "alias_search": alias_search,
    "session_carry": session_carry,
    "session_last5": session_last5,
    "session_complete": session_complete,
    "session_ttl": _sessions("30 minutes"),
    "session_ttl_6h": _sessions("6 hours"),
    "cache_hits": cache_hits,
    "html_text": html_text,
    "url_source": url_source,
    "relative_time": relative_time,
    "json_props": json_props,
    "term_search": term_search,
    "number_match": number_match,
    "keyword_coverage": keyword_coverage,
    "answer_status": answer_status,
    "eval_rollup": eval_rollup,
    "eval_metrics": eval_metrics,
    "stream_session_state": stream_session_state,
    "stream_session_control": stream_session_control,
}

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({t}, '')), '\\s+'), lambda x: x <> '')"
_LANG = "['en', 'fr', 'de', 'es'][(item_id % 4 + 1)::INTEGER]"


def _bm25_sql(group: str) -> str:
    """Common table expressions up to hits(qid, doc_id, score)."""
    q, d = ("0", "0") if group == "all" else (_LANG, "lang")
    return f"""WITH dt AS (SELECT doc_id, g, term, count(*) AS tf FROM (SELECT doc_id, {d} AS g, unnest({_WORDS.format(t="text")}) AS term FROM documents) GROUP BY ALL),
      qt AS (SELECT qid, g, term, count(*) AS qtf FROM (SELECT item_id AS qid, {q} AS g, unnest({_WORDS.format(t="text")}) AS term FROM benchmark) GROUP BY ALL),
      dl AS (SELECT doc_id, {d} AS g, len({_WORDS.format(t="text")}) AS dl FROM documents), sz AS (SELECT g, count(*) AS n, avg(dl) AS a FROM dl GROUP BY g),
      df AS (SELECT g, term, count(*) AS df FROM dt GROUP BY ALL), i0 AS (SELECT g, term, a, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM df JOIN sz USING (g)),
      i1 AS (SELECT *, avg(idf) OVER (PARTITION BY g) AS m FROM i0), i AS (SELECT g, term, a, CASE WHEN idf < 0 THEN {retrieval.FLOOR} * m ELSE idf END AS idf FROM i1),
      hits AS (SELECT qid, doc_id, round(sum(qtf * idf * tf * {retrieval.K1 + 1} / (tf + {retrieval.K1} * (1 - {retrieval.B} + {retrieval.B} * dl / a))), 5) AS score
        FROM qt JOIN i USING (g, term) JOIN dt USING (g, term) JOIN dl USING (doc_id) GROUP BY qid, doc_id),
      ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM hits)"""


_NEAREST_SQL = f"""near AS (SELECT q.vec_id AS qid, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
      FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
    nearest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM near) WHERE rank <= {K})"""


def _fused_sql(weights, c) -> str:
    return _bm25_sql("all") + f""", {_NEAREST_SQL}, parts AS (SELECT qid, doc_id AS key, {weights[0]}::DOUBLE / (rank + {c}) AS p, rank AS r FROM ranked WHERE rank <= {K}
      UNION ALL SELECT qid, vec_id, {weights[1]}::DOUBLE / (rank + {c}), NULL FROM nearest), f AS (SELECT qid, key, round(sum(p), 9) AS score, min(r) AS r FROM parts GROUP BY ALL),
      o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, coalesce(r, 1000)::BIGINT * 1000000000 + key)::INTEGER AS rank FROM f)
      SELECT qid, key AS doc_id, score, rank FROM o WHERE rank <= {K}"""


_SECTIONS = f"sections AS (SELECT * FROM documents WHERE length(text) >= 100 AND NOT regexp_matches(string_split(text, chr(10))[1], '{'|'.join(BLOCKED)}'))"


# Written out here, not taken from the library, so that agreement shows that both have the same values.
_ENDINGS_SQL = "입니다|이며|이다|합니다|있습니다|하고|에서|으로|부터|까지|등이|등은|되어|되고"
_STOPWORDS_SQL = """'있습니다', '입니다', '합니다', '하고', '있으며', '있다', '이다', '되고', '되어', '기준', '관련', '주요', '다음', '같은', '통해', '위한', '위해', '대한', '대해',
  '이러한', '그리고', '또한', '또는', '그러나', '하지만', '당사', '회사', '당기', '전기', '우리', '습니다', '니다'"""


def _tokens_sql(t: str) -> str:
    words = f"list_filter(string_split(regexp_replace(coalesce({t}, ''), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda w: length(w) >= 2)"
    return f"list_transform({words}, lambda w: regexp_replace(w, '^(.{{2,}})(?:{_ENDINGS_SQL})$', '\\1'))"


def _keywords_sql(t: str) -> str:
    return f"list_distinct(list_filter({_tokens_sql(t)}, lambda w: w NOT IN ({_STOPWORDS_SQL})))"


def _coverage_sql(truth: str, answer: str) -> str:
    inside = f"replace(coalesce({answer}, ''), ' ', '')"
    hit = f"contains({inside}, w) OR (length(w) > 2 AND contains({inside}, left(w, length(w) - 1)))"
    return f"round(len(list_filter({_keywords_sql(truth)}, lambda w: {hit}))::DOUBLE / nullif(len({_keywords_sql(truth)}), 0), 3)"


def _numbers_sql(t: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(coalesce({t}, ''), '[0-9,]+(?:\\.[0-9]+)?'), lambda x: replace(x, ',', '')), lambda x: length(x) >= 4)"


def _main_sql(t: str) -> str:
    n = _numbers_sql(t)
    return f"list_filter({n}, lambda x: length(x) = list_max(list_transform({n}, lambda y: length(y))))[1]"


_ENTITY = "CASE " + " ".join(f"WHEN contains(text, '{a}') THEN '{b}'" for a, b in sorted(ENTITIES, key=lambda x: -len(x[0]))) + " END"
_STATUS = "CASE WHEN coalesce({a}, '') = '' THEN 'empty' WHEN contains({a}, '답변 생성 중 오류') THEN 'error' WHEN contains({a}, '찾을 수 없') OR contains({a}, '확인할 수 없') THEN 'not_found' ELSE 'answered' END"
_STRIP = "trim(regexp_replace({t}, '\\s+', ' ', 'g'))"
_QUESTIONS = """q AS (SELECT * FROM (SELECT conv_id, turn, role, text, lead(text) OVER w AS reply, lead(text, 3) OVER w AS later
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)) WHERE role = 'user')"""
_ANSWERS = f"""WITH {_QUESTIONS}, a AS (SELECT 'reply' AS system, 'turn ' || turn AS category, text AS truth, reply AS answer FROM q
  UNION ALL SELECT 'later', 'turn ' || turn, text, later FROM q),
  s AS (SELECT system, category, {_STATUS.format(a="answer")} AS status, CASE WHEN {_main_sql("truth")} IS NOT NULL THEN list_contains({_numbers_sql("answer")}, {_main_sql("truth")})::INTEGER END AS number,
    {_coverage_sql("truth", "answer")} AS coverage FROM a)"""


def _sessions_sql(gap: str) -> str:
    return f"""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL '{gap}' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e) SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM g GROUP BY user_id, s"""


def _flat_sql(t: str) -> str:
    for tag in ("script", "style", "noscript"):
        t = f"regexp_replace({t}, '(?is)<{tag}\\b.*?</{tag}>', ' ', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '<[^>]+>', ' ', 'g'), '<[^>]+>', '', 'g')"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        t = f"replace({t}, '{name}', '{char}')"
    return _STRIP.format(t=t)


def _route_sql() -> str:
    rows = ", ".join(
        f"({i}, '{intent}', {repr(acc) if acc else 'NULL'}, {'{c}' in t}, {'{s}' in t}, {'{y}' in t}, {repr(st) if st else 'NULL'}, {repr(sc) if sc else 'NULL'}, '{cp}', {repr(ty) if ty else 'NULL'}, {repr(va) if va else 'NULL'})"
        for i, ((t, intent, acc, _), (st, sc, cp, ty, va)) in enumerate(
            zip(TEMPLATES, [("IS", "FY", "C", "during", "A"), ("BS", None, "C", "end", None), ("IS", "2Q", "C", "during", "A"), (None, None, "C", None, None), (None, None, "C", None, None), (None, None, "C", None, None),
                            (None, None, "C", None, None), (None, None, "C", None, None), ("IS", "3Q", "P", "during", "A"), (None, None, "C", None, None)], strict=True)
        )
    )
    return f"""SELECT c_custkey AS qid, CASE WHEN hc THEN 'NATION_' || c_nationkey END AS corp, acc AS account, CASE WHEN hs THEN c_mktsegment END AS sector, st AS statement,
      CASE WHEN hy THEN (2000 + c_custkey % 25)::INTEGER END AS year, sc AS scope, cp, ty AS type, va AS variant, intent,
      (CASE WHEN hc THEN 40 ELSE 0 END + CASE WHEN acc IS NULL THEN 0 ELSE 30 END + CASE WHEN hy THEN 15 ELSE 0 END + CASE WHEN sc IS NULL THEN 0 ELSE 15 END) / 100.0::DOUBLE AS confidence
      FROM customer JOIN (VALUES {rows}) t(i, intent, acc, hc, hs, hy, st, sc, cp, ty, va) ON c_custkey % 10 = i"""


ORACLES = {
    "doc_sections": f"WITH {_SECTIONS} SELECT doc_id, length(text)::BIGINT AS char_count, md5('[' || source || ' / ' || lang || ']' || chr(10) || text) AS headed_md5, md5(text) AS text_md5 FROM sections",
    "chunk_stride": f"""WITH {_SECTIONS}, c AS (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 100) / 900.0)::INTEGER, 1))) AS i FROM sections)
      SELECT doc_id, i::INTEGER AS chunk_idx, length(substring(text, i * 900 + 1, 1000))::INTEGER AS n, md5(substring(text, i * 900 + 1, 1000)) AS chunk_md5 FROM c""",
    "chunk_stats": f"""WITH {_SECTIONS}, c AS (SELECT source, greatest(ceil((length(text) - 100) / 900.0), 1)::BIGINT AS n FROM sections)
      SELECT source, sum(n)::BIGINT AS n_chunks, count(*) AS n_sections, round(sum(n)::DOUBLE / count(*), 4) AS mean_chunks FROM c GROUP BY source""",
    "bm25_topk": _bm25_sql("all") + f" SELECT qid, doc_id, score, rank FROM ranked WHERE rank <= {K}",
    "bm25_filtered": _bm25_sql("lang") + f" SELECT qid, doc_id, score, rank FROM ranked WHERE rank <= {K}",
    "vector_topk": f"WITH {_NEAREST_SQL} SELECT qid, vec_id, score, rank FROM nearest",
    "hybrid_fusion": _fused_sql((0.4, 0.6), 0),
    "fusion_rrf60": _fused_sql((0.5, 0.5), 60),
    "filter_relaxation": _bm25_sql("all") + f""", h AS (SELECT r.qid, r.doc_id, r.score, CASE WHEN source = 'src' || (qid % 20) THEN CASE WHEN lang = ['en', 'fr', 'de', 'es'][(qid % 4 + 1)::INTEGER] THEN 0 ELSE 1 END ELSE 2 END AS level
        FROM ranked r JOIN documents USING (doc_id)), m AS (SELECT *, min(level) OVER (PARTITION BY qid) AS applied FROM h),
      t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS rank FROM m WHERE level = applied), k AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM t WHERE rank <= 5)
      SELECT qid, doc_id, rank, applied, CASE WHEN applied > 0 THEN 'low' WHEN n >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM k""",
    "retrieve": _bm25_sql("all") + f""", h AS (SELECT r.qid, r.doc_id, r.score, CASE WHEN source = 'src' || (qid % 20) THEN CASE WHEN lang = ['en', 'fr', 'de', 'es'][(qid % 4 + 1)::INTEGER] THEN 0 ELSE 1 END ELSE 2 END AS level
        FROM ranked r JOIN documents USING (doc_id)), m AS (SELECT *, min(level) OVER (PARTITION BY qid) AS applied FROM h),
      t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id)::INTEGER AS before FROM m WHERE level = applied),
      b AS (SELECT t.qid, t.doc_id, before, applied, list_distinct({_tokens_sql("lower(q.text)")}) AS w, list_distinct({_tokens_sql("lower(left(d.text, 1500))")}) AS t FROM t JOIN benchmark q ON q.item_id = t.qid JOIN documents d USING (doc_id) WHERE before <= {K}),
      s AS (SELECT qid, doc_id, before, applied, round(len(list_intersect(w, t))::DOUBLE / nullif(len(w), 0), 6) AS overlap FROM b),
      o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, before)::INTEGER AS rank FROM s), k AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n FROM o WHERE rank <= 3)
      SELECT qid, doc_id, rank, applied, CASE WHEN applied > 0 THEN 'low' WHEN n >= 3 THEN 'high' ELSE 'medium' END AS confidence FROM k""",
    "rerank_overlap": _bm25_sql("all") + f""", b AS (SELECT r.qid, r.doc_id, r.rank AS before, list_distinct({_tokens_sql("lower(q.text)")}) AS w, list_distinct({_tokens_sql("lower(left(d.text, 1500))")}) AS t FROM ranked r JOIN benchmark q ON q.item_id = r.qid JOIN documents d USING (doc_id)
        WHERE r.rank <= {K}), s AS (SELECT qid, doc_id, before, round(len(list_intersect(w, t))::DOUBLE / nullif(len(w), 0), 6) AS overlap FROM b),
      o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, before)::INTEGER AS rank FROM s) SELECT * FROM o WHERE rank <= 3""",
    "route_intent": _route_sql(),
    "alias_search": """WITH a AS (SELECT w AS alias, min(lang) AS name FROM (SELECT unnest(regexp_extract_all(text, '[a-zà-ÿ]{5,}')) AS w, lang FROM documents) GROUP BY w),
      t AS (SELECT conv_id || '/' || turn AS id, replace(text, ' ', '') AS t FROM conversations), l AS (SELECT DISTINCT length(alias) AS n FROM a),
      s AS (SELECT DISTINCT id, substr(t, i, n) AS s FROM t, l, range(1, length(t) + 1) AS r(i) WHERE i <= length(t) - n + 1)
      SELECT id, alias, name FROM (SELECT id, alias, name, row_number() OVER (PARTITION BY id ORDER BY length(alias) DESC, alias, name) AS k FROM s JOIN a ON s.s = a.alias) WHERE k = 1""",
    "longest_alias": """WITH a AS (SELECT p_name AS alias, upper(p_name) AS name FROM part UNION SELECT string_split(p_name, ' ')[1], 'first word' FROM part),
      t AS (SELECT p_partkey, ' ' || regexp_replace(lower(concat_ws(' ', 'The', p_name, p_type, p_brand)), '\\W+', ' ', 'g') || ' ' AS t FROM part),
      h AS (SELECT p_partkey, lower(alias) AS alias, name, row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC, lower(alias), name) AS rn FROM t JOIN a ON contains(t, ' ' || lower(alias) || ' '))
      SELECT p_partkey, alias, name FROM h WHERE rn = 1""",
    "session_carry": f"""WITH t AS (SELECT conv_id, turn, {_ENTITY} AS entity FROM conversations WHERE role = 'user')
      SELECT conv_id, turn, entity, last_value(entity IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_entity FROM t""",
    "session_last5": """SELECT conv_id, turn, array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS history FROM conversations""",
    "session_ttl": _sessions_sql("30 minutes"),
    "session_ttl_6h": _sessions_sql("6 hours"),
    "cache_hits": """WITH RECURSIVE m AS (SELECT user_id, min(ts) AS at FROM events GROUP BY user_id
        UNION ALL SELECT m.user_id, min(e.ts) FROM m JOIN events e ON e.user_id = m.user_id AND date_diff('second', m.at, e.ts) >= 21600 AND epoch(e.ts) - epoch(m.at) >= 21600 GROUP BY m.user_id, m.at)
      SELECT e.user_id, event_id, m.at IS NULL AS hit FROM events e LEFT JOIN m ON m.user_id = e.user_id AND m.at = e.ts""",
    "html_text": f"SELECT page_id, length({_flat_sql('html')})::BIGINT AS n_chars, md5({_flat_sql('html')}) AS text_md5 FROM pages",
    "url_source": """WITH h AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^(www|m|news)\\.', '') AS h FROM pages)
      SELECT page_id, url, CASE WHEN h = '' THEN NULL WHEN h = 'example.com' THEN 'Example' WHEN h = 'example.org' THEN 'Example Org' WHEN h = 'example.net' THEN 'Example Net' WHEN h LIKE '%.example.org' THEN 'Example Org'
        WHEN h LIKE '%.example.net' THEN 'Example Net' ELSE upper(string_split(h, '.')[1]) END AS source FROM h""",
    "relative_time": f"""WITH e AS (SELECT event_id, ts, floor(epoch(TIMESTAMP '{NOW}') - epoch(ts))::BIGINT AS s FROM events)
      SELECT event_id, CASE WHEN s < 60 THEN '방금' WHEN s < 3600 THEN (s // 60) || '분 전' WHEN s < 86400 THEN (s // 3600) || '시간 전' WHEN s < 604800 THEN (s // 86400) || '일 전' ELSE strftime(ts + INTERVAL 9 HOUR, '%Y.%m.%d') END AS ago FROM e""",
    "json_props": """SELECT event_type, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS sum_k, count(json_extract_string(props, '$.k')) AS n, max('{"k":' || json_extract_string(props, '$.k') || '}') AS largest FROM events GROUP BY event_type""",
    "term_search": """WITH h AS (SELECT p_partkey, word, CASE WHEN lower(p_name) = lower(word) THEN 0 WHEN contains(lower(p_name), lower(word)) THEN 1 WHEN contains(lower(p_type), lower(word)) THEN 2 WHEN contains(lower(p_brand), lower(word)) THEN 3 END AS priority
        FROM part, (VALUES ('ring'), ('red widget'), ('STANDARD'), ('Brand#12'), ('e')) w(word)), r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY priority, p_partkey)::INTEGER AS rank FROM h WHERE priority IS NOT NULL)
      SELECT word, p_partkey, priority, rank FROM r WHERE rank <= 20""",
    "number_match": f"""WITH d AS (SELECT doc_id, text, regexp_replace(text, '^[^\\n]*\\n?', '') AS below FROM documents)
      SELECT doc_id, {_main_sql("text")} AS number, CASE WHEN {_main_sql("text")} IS NOT NULL THEN list_contains({_numbers_sql("below")}, {_main_sql("text")}) END AS ok FROM d""",
    "keyword_coverage": f"WITH {_QUESTIONS} SELECT conv_id, turn, {_coverage_sql('text', 'reply')} AS coverage FROM q",
    "answer_status": f"""WITH a AS (SELECT n_chars, CASE doc_id % 9 WHEN 0 THEN '' WHEN 1 THEN '답변 생성 중 오류가 발생했습니다: timeout' WHEN 2 THEN '값을 찾을 수 없습니다' ELSE text END AS a FROM documents), s AS (SELECT {_STATUS.format(a="a")} AS status, n_chars FROM a)
      SELECT status, count(*) AS n, round(sum(n_chars)::DOUBLE / count(*), 3) AS mean_chars FROM s GROUP BY status""",
    "eval_rollup": _ANSWERS + """ SELECT system, CASE WHEN grouping(category) = 1 THEN 'total' ELSE category END AS category, count(*) FILTER (status = 'answered') AS ok, count(*) AS n,
      ((count(*) FILTER (status = 'answered') * 2000 + count(*)) // (2 * count(*)))::DOUBLE / 10 AS pct FROM s GROUP BY GROUPING SETS ((system, category), (system))""",
    "eval_metrics": _ANSWERS + """, l AS (SELECT system, 'number' AS metric, number::DOUBLE AS v FROM s UNION ALL SELECT system, 'coverage', coverage FROM s)
      SELECT system, metric, count(v) AS n_valid, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM l GROUP BY ALL""",
    "stream_session_state": """WITH e AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 30 MINUTE, false) AS expired, lag(ts) OVER w IS NULL AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
      s AS (SELECT *, sum((expired OR f)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM e)
      SELECT user_id, event_id, n::INTEGER AS session_no, row_number() OVER w::INTEGER AS turn_no, array_to_string(list(event_type) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS history, expired
      FROM s WINDOW w AS (PARTITION BY user_id, n ORDER BY ts, event_id)""",
    "stream_session_control": """WITH k AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 37 = 0 THEN 'delete' WHEN event_id % 17 = 0 THEN 'reset' WHEN event_id % 23 = 0 THEN 'stats' ELSE event_type END AS t FROM events),
      g AS (SELECT *, coalesce(sum((t = 'delete')::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM k),
      p AS (SELECT *, lag(ts) OVER (PARTITION BY user_id, d ORDER BY ts, event_id) AS prev FROM g WHERE t NOT IN ('delete', 'stats')),
      f AS (SELECT *, coalesce(ts - prev > INTERVAL 2 DAY, false) AS forgot, coalesce(ts - prev > INTERVAL 6 HOUR, false) AS gap FROM p),
      r AS (SELECT *, sum(forgot::INTEGER) OVER (PARTITION BY user_id, d ORDER BY ts, event_id) AS r FROM f),
      s AS (SELECT *, sum((prev IS NULL OR gap OR t = 'reset')::INTEGER) OVER (PARTITION BY user_id, d, r ORDER BY ts, event_id) AS n FROM r),
      x AS (SELECT user_id, d, event_id, ts, n AS session_no, row_number() OVER w AS turn_no, row_number() OVER (PARTITION BY user_id, d, r ORDER BY ts, event_id) AS turns,
        array_to_string(list(t) OVER (w ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ',') AS history, gap AND NOT forgot AS expired FROM s WINDOW w AS (PARTITION BY user_id, d, r, n ORDER BY ts, event_id)),
      o AS (SELECT g.user_id, g.event_id, g.t, coalesce(g.ts - x.ts > INTERVAL 2 DAY, true) AS away, coalesce(g.ts - x.ts > INTERVAL 6 HOUR, false) AS quiet, x.session_no, x.turn_no, x.turns, x.history
        FROM (SELECT * FROM g WHERE t IN ('delete', 'stats')) g ASOF LEFT JOIN x ON g.user_id = x.user_id AND g.d = x.d AND g.ts >= x.ts)
      SELECT user_id, event_id, 'turn' AS kind, session_no::INTEGER AS session_no, turn_no::INTEGER AS turn_no, turns::BIGINT AS turns, history, expired FROM x
      UNION ALL SELECT user_id, event_id, CASE t WHEN 'delete' THEN 'deleted' ELSE 'stats' END, CASE WHEN away THEN 0 ELSE session_no END::INTEGER, CASE WHEN away OR quiet THEN 0 ELSE turn_no END::INTEGER,
        CASE WHEN away THEN 0 ELSE turns END::BIGINT, CASE WHEN away OR quiet OR t = 'delete' THEN '' ELSE history END, quiet AND NOT away FROM o""",
    "bm25_topk_pruned": _bm25_sql("all") + f" SELECT qid, doc_id, score, rank FROM ranked WHERE rank <= {K}",
    "vector_topk_cells": f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT q.vec_id AS qid, e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM n) WHERE rank <= {K}""",
}

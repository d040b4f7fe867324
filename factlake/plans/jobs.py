"""Queries of whole jobs: an index built in parts, results that meet by place, a batch of questions; with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims
from ..operators import answers, lookup, ordinals
from ..operators.asking import ask_batch as asked_batch
from ..sources import incremental
from ..sources.facts import built, read
from ..sources.shared import discard, folder, written
from .analytics import _IN, _RANKED, _amount_sql

# What stands for companies and accounts in the given dialogues.
CORPS = [("able", "NATION_5"), ("ción", "NATION_3"), ("heit", "NATION_4"), ("eau", "NATION_6"), ("que", "NATION_2"), ("ung", "NATION_1")]
ACCOUNTS = [("ness", "net_profit"), ("ich", "assets"), ("ver", "revenue"), ("oi", "operating_profit")]


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source, cut under all settings; the first ten sources are built first, then the rest."""
    docs = read(spark, sf_dir, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("section_idx"), "text")
    out = f"{folder(spark)}/index-{uuid.uuid4().hex}"
    incremental.build(docs, out, cut=incremental.strides, limit=10)
    incremental.build(docs, out, cut=incremental.strides)
    rows = incremental.chunks(spark, out).groupBy("source_file", "setting")
    done = written(rows.agg(F.countDistinct("section_idx").alias("n_sections"), F.count("*").alias("n_chunks"), F.sum(F.length("chunk")).cast("bigint").alias("n_chars")), "index-sizes")
    discard(spark, out)
    return done


def positional_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' turns and the assistants' as two lists in order: item by item, whatever their lengths."""
    turns = read(spark, sf_dir, "conversations")
    lists = {r: ordinals.with_ordinals(turns.where(F.col("role") == r).select("conv_id", "turn", "text"), [F.col("conv_id"), F.col("turn")]) for r in ("user", "assistant")}
    size = lambda r: F.length(f"{r}.text").cast("bigint").alias(f"{r}_chars")
    return ordinals.by_place(lists).select("place", F.col("user.conv_id").alias("user_conv"), F.col("assistant.conv_id").alias("assistant_conv"), size("user"), size("assistant"))


def ask_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' turns as questions: companies and accounts from tables of names, memory by dialogue, facts
    of the year asked for or the last one."""
    turns = read(spark, sf_dir, "conversations").where("role = 'user'")
    questions = turns.select((F.col("conv_id") * 10_000 + F.col("turn")).alias("qid"), F.col("conv_id").alias("session"), F.col("turn").cast("int").alias("turn"), "text")
    table = lambda names: spark.createDataFrame(names, "alias string, name string")
    names = {"corp": table(CORPS), "account": table(ACCOUNTS), "sector": [], "term": []}
    facts = lookup.first_match(built(spark, sf_dir), dims.YEARLY).select(F.col("corp_name").alias("corp"), "account", F.col("period_year").alias("y"), "value", "unit_hint")
    last = facts.where("value is not null").groupBy("corp", "account").agg(F.max_by(F.struct("y", "value", "unit_hint"), "y").alias("f")).select("corp", "account", F.lit(None).cast("int").alias("asked"), "f.*")
    known = written(last.unionByName(facts.withColumn("asked", F.col("y"))), "by-year")

    def fact(rows: DataFrame) -> DataFrame:
        met = rows.select("qid", "corp", "account", "year").join(known.withColumnsRenamed({"corp": "_c", "account": "_a"}), (F.col("corp") == F.col("_c")) & (F.col("account") == F.col("_a")) & F.col("year").eqNullSafe(F.col("asked")))
        return met.select("qid", answers.fact_answer(F.col("corp"), F.col("y").cast("string"), F.col("account"), F.col("value"), F.col("unit_hint")).alias("answer"))

    def told(rows: DataFrame) -> DataFrame:
        return rows.where("corp is not null").select("qid", F.concat(F.lit("sections of "), "corp").alias("answer"))

    return asked_batch(questions, names, {"fact_lookup": fact, "hybrid": fact, "narrative": told, "news_context": told})


QUERIES = {"index_build": index_build, "positional_turns": positional_turns, "ask_batch": ask_batch}

_CASE = lambda text, names: "CASE " + " ".join(f"WHEN contains({text}, '{a}') THEN '{n}'" for a, n in names) + " END"
_NO = answers.NOTHING
ORACLES = {
    "index_build": """WITH k(setting, size, overlap, least) AS (VALUES ('sections', 3000, 300, 0), ('vector', 1000, 100, 50), ('hybrid', 1200, 150, 50), ('table_aware', 1500, 200, 0), ('table_hybrid', 1200, 200, 0)),
      d AS (SELECT source, setting, length(text) AS n, size, size - overlap AS step, greatest(ceil((length(text) - overlap) / (size - overlap)), 1)::BIGINT AS c FROM documents, k WHERE source IS NOT NULL AND length(text) >= greatest(least, 1))
      SELECT source AS source_file, setting, count(*) AS n_sections, sum(c)::BIGINT AS n_chunks, sum(list_sum(list_transform(range(c), lambda i: least(size, n - i * step))))::BIGINT AS n_chars FROM d GROUP BY ALL""",
    "positional_turns": """WITH t AS (SELECT role, conv_id, length(text)::BIGINT AS n, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1 AS place FROM conversations)
      SELECT coalesce(u.place, a.place) AS place, u.conv_id AS user_conv, a.conv_id AS assistant_conv, u.n AS user_chars, a.n AS assistant_chars
      FROM (SELECT * FROM t WHERE role = 'user') u FULL JOIN (SELECT * FROM t WHERE role = 'assistant') a ON u.place = a.place""",
    "ask_batch": _RANKED + f""", lately AS (SELECT corp_name, account_norm, arg_max(base_value, period_year) AS v, max(period_year) AS y FROM best WHERE base_value IS NOT NULL AND account_norm IN {_IN(dims.YEARLY)} GROUP BY ALL),
      q AS (SELECT conv_id, turn, {_CASE("text", CORPS)} AS own, {_CASE("replace(text, ' ', '')", ACCOUNTS)} AS account FROM conversations WHERE role = 'user'),
      m AS (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM q),
      c AS (SELECT conv_id, turn, account, own, coalesce(own, past) AS corp FROM m),
      i AS (SELECT *, CASE WHEN corp IS NULL THEN 'general' WHEN account IS NOT NULL THEN 'fact_lookup' ELSE 'narrative' END AS intent FROM c),
      a AS (SELECT i.*, CASE intent WHEN 'fact_lookup' THEN corp || ' ' || y || ' ' || account || ': ' || {_amount_sql("v")} WHEN 'narrative' THEN 'sections of ' || corp END AS answer FROM i LEFT JOIN lately ON corp_name = corp AND account_norm = account)
      SELECT conv_id * 10000 + turn AS qid, conv_id AS session, turn::INTEGER AS turn, corp, account, NULL::INTEGER AS year, intent, own IS NULL AND corp IS NOT NULL AS used, coalesce(answer, '{_NO}') AS answer,
        CASE WHEN answer IS NULL THEN 'not_found' ELSE 'answered' END AS status FROM a""",
}

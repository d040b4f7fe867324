"""Queries on terms, reports' wording, answers and their evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, reports, text
from ..operators import answers, evaluate, lookup, ratios, terms
from ..sources.facts import EVERYTHING, SUGGESTED, aliased, built, companies, read, sector_bridge, sector_of, suggested
from ..sources.shared import written
from .analytics import _LONG, _RANKED, _amount_sql, _majority_sql, on_facts
from .text_queries import _coverage_sql, _main_sql, _numbers_sql, _route_sql, _STATUS, route_intent
from .text_queries import _QUESTIONS as _TURNS_SQL
from .text_queries import _questions as turns

# --- terms


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a dictionary: brand and size name a term; its full name holds type and name."""
    term = F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"))
    full = F.concat(term, F.lit(" ("), "p_type", F.lit(", "), "p_name", F.lit(", )"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), term.alias("term"), full.alias("name_full"), F.col("p_type").alias("category"), F.col("p_name").alias("definition"))


def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = read(spark, sf_dir, "part"), F.col("p_partkey") % 5
    word = F.when(k == 0, F.concat(F.lit(" "), F.lower("p_brand"), F.lit("-"), F.col("p_size").cast("string"))).when(k == 1, F.lower("p_type")).when(k == 2, F.col("p_name")).when(k == 3, F.lit("none of it"))
    return terms.lookup(p.select(F.col("p_partkey").alias("qid"), word.alias("word")), terms.keys(_terms(spark, sf_dir)))


def term_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.categories(_terms(spark, sf_dir))


# --- wording of reports

# Titles by number; {d} a date, {n} a number.
WORDING = ["연결 재무상태표 제 {n} 기 3분기말 {d}", "별도 손익 계산서 반기", "개별 포괄손익계산서 1Q (2024.3.9)", "연결 현금 흐름표 q4 2023년 3월 31일", "자본 변동표 기말", "대차대조표 3 분기", "사업의 개요"]


def report_wording(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report, statement, period, quarter, date and id that titles made from orders say."""
    k = F.col("o_orderkey")
    title = F.element_at(F.array(*map(F.lit, WORDING)), (k % len(WORDING) + 1).cast("int"))
    title = F.replace(F.replace(title, F.lit("{d}"), F.date_format("o_orderdate", "yyyy.MM.dd")), F.lit("{n}"), (k % 60).cast("string"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", title.alias("title"), F.year("o_orderdate").alias("year"))
    t = F.col("title")
    company = F.when(k % 3 > 0, F.concat(F.lit("A "), (k % 3).cast("string")))
    return rows.select(
        "o_orderkey",
        terms.first_pattern(t, reports.REPORT_TYPES).alias("report_type"),
        terms.first_pattern(t, reports.STATEMENTS).alias("statement"),
        terms.first_pattern(t, reports.PERIODS).alias("period"),
        reports.quarter(t).alias("quarter"),
        reports.period_end(t).alias("period_end"),
        reports.item_id(company, F.col("year"), reports.quarter(t), "t", k, t).alias("table_id"),
    )


def title_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of paragraphs made from an order, those with a date or a business year, up to three."""
    k = F.col("o_orderkey")
    maybe = lambda every, value: F.when(k % every == 0, value).otherwise("없음")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    paragraphs = F.array(maybe(2, F.concat(F.lit("제 "), (k % 60).cast("string"), F.lit(" 기"))), F.lit("단위 : 원"), maybe(3, day), maybe(5, F.concat(F.lit("기준 "), day)), maybe(1, F.lit("2024.01.02 현재")))
    return read(spark, sf_dir, "orders").select("o_orderkey", reports.dated(paragraphs).alias("dates"))


def page_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages made from regions, each with a table of its nations, as text with the table in its place."""
    cell = F.concat(F.lit("<tr><td>"), F.col("n_name"), F.lit("</td><td class='n'>"), F.when(F.col("n_nationkey") % 3 > 0, F.col("n_nationkey").cast("string")).otherwise(" "), F.lit("</td></tr>"))
    rows = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", cell.alias("c")))).alias("r"))
    html = F.concat(F.lit("<script>var t = '<table>';</script><h1>Region "), F.col("n_regionkey").cast("string"), F.lit("</h1><table><tr><th>name</th><th>a|b</th></tr>"), F.array_join("r.c", ""), F.lit("</table><p>the &lt;end&gt;</p><table></table>"))
    return rows.select("n_regionkey", text.table_text(html).alias("text"))


# --- evaluation


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two systems' answers to users' turns: the next turn, and a later one."""
    kind = F.element_at(F.array(*map(F.lit, ("fact_lookup", "narrative", "hybrid", "general"))), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    system = F.explode(F.array(*[F.struct(F.lit(x).alias("system"), F.col(x).alias("answer")) for x in ("reply", "later")]))
    rows = turns(spark, sf_dir).select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), kind.alias("intent"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("category"), F.col("text").alias("truth"), system.alias("s"))
    rows = evaluate.scored(rows.select("id", "intent", "category", "truth", "s.system", "s.answer"))
    confidence = F.when(F.col("number_ok"), "high").when(F.col("coverage") > 0, "medium").otherwise("low")
    return rows.withColumns({"elapsed": F.length("answer"), "intent_correct": evaluate.intent_correct(text.main_number(F.col("truth")), F.col("intent")), "confidence": confidence})


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary(_scored(spark, sf_dir))


def eval_summary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.summary_json(evaluate.summary(_scored(spark, sf_dir)).select("system", "total", "fact_lookup_n", "narrative_n"))


def eval_fact_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.fact_accuracy(_scored(spark, sf_dir))


def eval_document_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of every document, without its first line and of its first line only, scored by the
    document's main number, by language."""
    below, head = F.regexp_replace("text", r"^[^\n]*\n?", ""), F.substring_index("text", "\n", 1)
    readings = F.explode(F.array(*[F.struct(F.lit(n).alias("system"), c.alias("answer")) for n, c in (("below", below), ("head", head))]))
    rows = read(spark, sf_dir, "documents").select("text", F.col("lang").alias("category"), readings.alias("r"))
    return evaluate.fact_accuracy(rows.select("r.system", "category", text.number_match(F.col("text"), F.col("r.answer")).alias("number_ok")))


def eval_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.distribution(_scored(spark, sf_dir), "intent", "confidence", "status")


def eval_side_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.side_by_side(_scored(spark, sf_dir), ("reply", "later"))


# --- companies and answers

# Other names of companies.
COMPANY_ALIASES = [(f"Nation No. {k}", f"NATION_{k}") for k in range(0, 25, 2)] + [("n4", "NATION_4")]


def company_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey").cast("string")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Nation No. "), k)).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("NATION NO. "), k)).otherwise(F.concat(F.lit("N"), k))
    return aliased(read(spark, sf_dir, "customer").select("c_custkey", name.alias("corp_name")), "corp_name", spark.createDataFrame(COMPANY_ALIASES, "alias string, stands_for string"))


def sector_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies by sector, each with the sector that is its own."""
    bridge = sector_bridge(spark, sf_dir)
    return bridge.join(sector_of(bridge).withColumnRenamed("sector", "own"), "corp_name").select("sector", "corp_name", "own")


def suggested_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggested(companies(spark, sf_dir).select("sector").distinct())


def merged_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes with what a port read: every third question, as a narrative on the year 1999."""
    rules = route_intent(spark, sf_dir)
    port = rules.where("qid % 3 = 0").select("qid", F.lit("narrative").alias("intent"), F.lit("NATION_1").alias("corp"), F.lit(1999).alias("year"))
    return answers.merged(rules, port, ("corp", "year")).select("qid", "intent", "corp", "year")


def answers_by_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed questions answered by intent, facts by template; memory gives every fourth general one a company."""
    rows = written(route_intent(spark, sf_dir), "routed")  # every handler reads it
    rows = rows.withColumn("late", (F.col("qid") % 4 == 3) & F.col("corp").isNull() & (F.col("intent") == "general"))
    rows = rows.withColumn("corp", F.when(F.col("late"), "NATION_2").otherwise(F.col("corp")))
    rows = rows.withColumn("intent", answers.reclassified(F.col("intent"), F.col("late"), F.col("corp"), F.col("account")))
    rows = written(rows, "remembered")
    facts = lookup.first_match(built(spark, sf_dir), dims.YEARLY).select(F.col("corp_name").alias("corp"), "account", F.col("period_year").alias("year"), "value", "unit_hint")
    asked = rows.select("qid", "corp", "account", (F.col("year") - 8).alias("year"), "intent")
    fact = asked.join(facts, ["corp", "account", "year"], "left")
    fact = fact.select("qid", answers.fact_answer(F.col("corp"), F.col("year").cast("string"), F.col("account"), F.col("value"), F.col("unit_hint")).alias("answer"))
    told = asked.where("corp is not null").select("qid", F.concat(F.lit("sections of "), "corp").alias("answer"))
    return answers.answered(asked, {"fact_lookup": fact, "hybrid": fact, "narrative": told, "news_context": told})


QUERIES = {
    "term_lookup": term_lookup,
    "term_categories": term_categories,
    "report_wording": report_wording,
    "title_dates": title_dates,
    "page_tables": page_tables,
    "eval_summary": eval_summary,
    "eval_summary_json": eval_summary_json,
    "eval_fact_accuracy": eval_fact_accuracy,
    "eval_document_accuracy": eval_document_accuracy,
    "eval_distribution": eval_distribution,
    "eval_side_by_side": eval_side_by_side,
    "company_alias": company_alias,
    "sector_listing": sector_listing,
    "suggested_questions": suggested_questions,
    "merged_routes": merged_routes,
    "answers_by_intent": answers_by_intent,
    "grade_explanations": on_facts(ratios.explained),
    "grade_texts": on_facts(ratios.summaries),
}


def _first_sql(t: str, patterns: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN '{name}'" for p, name in patterns) + " END"


_TERMS_SQL = """terms AS (SELECT p_partkey AS ordinal, p_brand || '-' || p_size AS term, p_type, p_name FROM part),
  keys AS (SELECT key, max(ordinal) AS ordinal FROM (SELECT ordinal, unnest([term, upper(term), p_type, upper(p_type), p_name, upper(p_name)]) AS key FROM terms) GROUP BY key)"""
_QUARTER_SQL = "coalesce(nullif(regexp_extract(title, '([1-4])\\s*분기', 1), '')::INTEGER, nullif(regexp_extract(upper(title), '([1-4])Q|Q[1-4]', 1), '')::INTEGER, nullif(regexp_extract(upper(title), 'Q([1-4])', 1), '')::INTEGER, CASE WHEN contains(title, '반기') THEN 2 END)"
_SCORED_SQL = f"""WITH {_TURNS_SQL}, a AS (SELECT 'reply' AS system, *, reply AS answer FROM q UNION ALL SELECT 'later', *, later FROM q),
  s AS (SELECT system, conv_id || '/' || turn AS id, 'turn ' || turn AS category, ['fact_lookup', 'narrative', 'hybrid', 'general'][((conv_id + turn) % 4 + 1)::INTEGER] AS intent, {_STATUS.format(a="answer")} AS status,
    {_main_sql("text")} IS NOT NULL AS has, CASE WHEN {_main_sql("text")} IS NOT NULL THEN list_contains({_numbers_sql("answer")}, {_main_sql("text")}) END AS ok, {_coverage_sql("text", "answer")} AS coverage, length(answer) AS elapsed FROM a),
  e AS (SELECT *, CASE WHEN (has AND intent = 'fact_lookup') OR (NOT has AND intent = 'narrative') OR intent = 'hybrid' THEN 1 ELSE 0 END AS suits,
    CASE WHEN ok THEN 'high' WHEN coverage > 0 THEN 'medium' ELSE 'low' END AS confidence FROM s)"""
_LABEL_SQL = lambda c: f"CASE {c} " + " ".join(f"WHEN '{g}' THEN '{t}'" for g, t in ratios.GRADE_LABELS.items()) + f" ELSE '{ratios.NO_DATA}' END"
_SIGNALS_SQL = """notes AS (SELECT r.corp_name, r.period_year, list_filter([
    CASE WHEN g.n = 2 AND operating_margin IS NOT NULL THEN 'leverage warning' END, CASE WHEN operating_margin - net_margin > 5 THEN 'non-operating loss' END,
    CASE WHEN net_margin - operating_margin > 3 THEN 'one-off gain' END, CASE WHEN s.c > 0 AND p.c < 0 THEN 'margin pressure' END,
    CASE WHEN s.c < 0 AND p.c > 0 THEN 'cost efficiency' END, CASE WHEN s.c > 5 AND p.c > s.c THEN 'strong growth' END], lambda x: x IS NOT NULL) AS notes
  FROM ratios r LEFT JOIN (SELECT corp_name, period_year, change_pct AS c FROM yoy WHERE account = 'revenue') s USING (corp_name, period_year)
  LEFT JOIN (SELECT corp_name, period_year, change_pct AS c FROM yoy WHERE account = 'operating_profit') p USING (corp_name, period_year)
  LEFT JOIN (SELECT corp_name, period_year, count(*) AS n FROM graded WHERE (ratio = 'roe' AND grade = 'excellent') OR (ratio = 'debt' AND grade IN ('warning', 'danger')) GROUP BY ALL) g USING (corp_name, period_year))"""
_ALIASES_SQL = ", ".join(f"('{a}', '{b}')" for a, b in COMPANY_ALIASES)
_ROUTES_SQL = f"r AS ({_route_sql()})"

ORACLES = {
    "term_lookup": f"""WITH {_TERMS_SQL}, q AS (SELECT p_partkey AS qid, CASE p_partkey % 5 WHEN 0 THEN ' ' || lower(p_brand) || '-' || p_size WHEN 1 THEN lower(p_type) WHEN 2 THEN p_name WHEN 3 THEN 'none of it' END AS word FROM part),
      f AS (SELECT qid, arg_min(ordinal, i) AS ordinal FROM (SELECT qid, unnest([1, 2, 3]) AS i, unnest([trim(word), upper(trim(word)), lower(trim(word))]) AS key FROM q) JOIN keys USING (key) GROUP BY qid)
      SELECT q.qid, word, term, p_type AS category, p_name AS definition FROM q LEFT JOIN f USING (qid) LEFT JOIN terms USING (ordinal)""",
    "term_categories": f"WITH {_TERMS_SQL} SELECT p_type AS category, count(*) AS n, row_number() OVER (ORDER BY min(ordinal))::INTEGER AS position FROM terms GROUP BY p_type",
    "report_wording": f"""WITH t AS (SELECT o_orderkey, year(o_orderdate) AS year, replace(replace([{", ".join(f"'{w}'" for w in WORDING)}][(o_orderkey % {len(WORDING)} + 1)::INTEGER], '{{d}}', strftime(o_orderdate, '%Y.%m.%d')), '{{n}}', (o_orderkey % 60)::VARCHAR) AS title FROM orders),
      u AS (SELECT *, {_QUARTER_SQL} AS quarter, regexp_extract(title, '(\\d{{4}})\\s*년\\s*(\\d{{1,2}})\\s*월\\s*(\\d{{1,2}})\\s*일', ['y', 'm', 'd']) AS a, regexp_extract(title, '(\\d{{4}})[-.](\\d{{1,2}})[-.](\\d{{1,2}})', ['y', 'm', 'd']) AS b FROM t)
      SELECT o_orderkey, {_first_sql("title", reports.REPORT_TYPES)} AS report_type, {_first_sql("title", reports.STATEMENTS)} AS statement, {_first_sql("title", reports.PERIODS)} AS period, quarter,
        CASE WHEN a.y <> '' THEN a.y || '-' || lpad(a.m, 2, '0') || '-' || lpad(a.d, 2, '0') WHEN b.y <> '' THEN b.y || '-' || lpad(b.m, 2, '0') || '-' || lpad(b.d, 2, '0') END AS period_end,
        CASE WHEN o_orderkey % 3 > 0 THEN 'A_' || (o_orderkey % 3) ELSE 'unknown' END || '_' || year || coalesce('Q' || quarter, 'Y') || '_t' || printf('%04d', o_orderkey) || '_' || left(md5(title), 8) AS table_id FROM u""",
    "title_dates": """WITH p AS (SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN '제 ' || (o_orderkey % 60) || ' 기' END, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END,
        CASE WHEN o_orderkey % 5 = 0 THEN '기준 ' || strftime(o_orderdate, '%Y-%m-%d') END, '2024.01.02 현재'], lambda x: x IS NOT NULL) AS p FROM orders) SELECT o_orderkey, array_to_string(p[1:3], ' | ') AS dates FROM p""",
    "page_tables": """SELECT n_regionkey, 'Region ' || n_regionkey || ' ' || chr(10) || chr(10) || '| name | a\\|b |' || chr(10) || '| --- | --- |' || chr(10)
        || string_agg('| ' || n_name || ' | ' || CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey::VARCHAR ELSE ' ' END || ' |', chr(10) ORDER BY n_nationkey) || chr(10) || chr(10) || ' the <end>' AS text FROM nation GROUP BY n_regionkey""",
    "eval_summary": _SCORED_SQL + """ SELECT system, count(*) AS total, count(*) FILTER (intent = 'fact_lookup') AS fact_lookup_n, count(*) FILTER (intent = 'narrative') AS narrative_n, count(*) FILTER (intent = 'hybrid') AS hybrid_n,
      round(avg(ok::INTEGER) FILTER (intent = 'fact_lookup'), 3) AS fact_accuracy, round((sum(coverage::DECIMAL(18,6)) FILTER (intent = 'narrative'))::DOUBLE / nullif(count(coverage) FILTER (intent = 'narrative'), 0), 3) AS narrative_coverage,
      round(avg(suits), 3) AS intent_accuracy, round(avg(elapsed), 2) AS mean_elapsed FROM e GROUP BY system""",
    "eval_summary_json": _SCORED_SQL + """ SELECT system, '{"total":' || count(*) || ',"fact_lookup_n":' || (count(*) FILTER (intent = 'fact_lookup')) || ',"narrative_n":' || (count(*) FILTER (intent = 'narrative')) || '}' AS summary FROM e GROUP BY system""",
    "eval_fact_accuracy": _SCORED_SQL + """ SELECT system, CASE WHEN grouping(category) = 1 THEN 'total' ELSE category END AS category, count(*) AS n, sum(ok::INTEGER)::BIGINT AS correct,
      ((sum(ok::INTEGER) * 200 + count(*)) // (2 * count(*)))::BIGINT AS pct FROM e WHERE ok IS NOT NULL GROUP BY GROUPING SETS ((system, category), (system))""",
    "eval_document_accuracy": f"""WITH d AS (SELECT text, lang, {_main_sql("text")} AS number FROM documents),
      r AS (SELECT 'below' AS system, lang AS category, number, regexp_replace(text, '^[^\\n]*\\n?', '') AS answer FROM d UNION ALL SELECT 'head', lang, number, string_split(text, chr(10))[1] FROM d),
      e AS (SELECT system, category, list_contains({_numbers_sql("answer")}, number) AS ok FROM r WHERE number IS NOT NULL)
      SELECT system, CASE WHEN grouping(category) = 1 THEN 'total' ELSE category END AS category, count(*) AS n, sum(ok::INTEGER)::BIGINT AS correct, ((sum(ok::INTEGER) * 200 + count(*)) // (2 * count(*)))::BIGINT AS pct
      FROM e GROUP BY GROUPING SETS ((system, category), (system))""",
    "eval_distribution": _SCORED_SQL + """ SELECT field, value, count(*) AS n FROM (SELECT 'intent' AS field, intent AS value FROM e UNION ALL SELECT 'confidence', confidence FROM e UNION ALL SELECT 'status', status FROM e) GROUP BY ALL""",
    "eval_side_by_side": _SCORED_SQL + """ SELECT id, category, max(status) FILTER (system = 'reply') AS reply, max(status) FILTER (system = 'later') AS later FROM e GROUP BY ALL""",
    "company_alias": f"""WITH a(alias, s) AS (VALUES {_ALIASES_SQL}), c AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Nation No. ' WHEN 1 THEN 'NATION NO. ' ELSE 'N' END || c_nationkey AS n FROM customer)
      SELECT c_custkey, coalesce((SELECT min(s) FROM a WHERE alias = n), (SELECT min(s) FROM a WHERE lower(alias) = lower(n)), n) AS corp_name FROM c""",
    "sector_listing": f"SELECT unnest(['{EVERYTHING}', r_name]) AS sector, n_name AS corp_name, r_name AS own FROM nation JOIN region ON r_regionkey = n_regionkey",
    "suggested_questions": "SELECT r_name AS sector, (i - 1)::INTEGER AS position, replace(l[i], '{s}', r_name) AS question FROM (SELECT r_name, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT DISTINCT r_name, CASE r_name "
      + " ".join(f"WHEN '{s}' THEN [{', '.join(map(repr, x))}]" for s, x in SUGGESTED.items() if s) + f" ELSE [{', '.join(map(repr, SUGGESTED[None]))}] END AS l FROM region JOIN nation ON n_regionkey = r_regionkey))",
    "merged_routes": f"""WITH {_ROUTES_SQL} SELECT qid, CASE WHEN confidence < {answers.SURE} AND qid % 3 = 0 THEN 'narrative' ELSE intent END AS intent, CASE WHEN confidence < {answers.SURE} AND qid % 3 = 0 THEN coalesce(corp, 'NATION_1') ELSE corp END AS corp,
      CASE WHEN confidence < {answers.SURE} AND qid % 3 = 0 THEN coalesce(year, 1999) ELSE year END AS year FROM r""",
    "answers_by_intent": _RANKED + f""", {_ROUTES_SQL}, m AS (SELECT *, qid % 4 = 3 AND corp IS NULL AND intent = 'general' AS late FROM r),
      t AS (SELECT qid, CASE WHEN late THEN 'NATION_2' ELSE corp END AS corp, account, year - 8 AS year, CASE WHEN late THEN CASE WHEN account IS NULL THEN 'narrative' ELSE 'fact_lookup' END ELSE intent END AS intent FROM m),
      f AS (SELECT t.*, base_value AS v FROM t LEFT JOIN best ON corp_name = corp AND account_norm = account AND period_year = year AND account_norm IN ({", ".join(repr(a) for a in dims.YEARLY)})),
      o AS (SELECT qid, intent, CASE WHEN intent IN ('fact_lookup', 'hybrid') THEN CASE WHEN v IS NULL OR corp IS NULL THEN NULL ELSE corp || ' ' || year || ' ' || account || ': ' || {_amount_sql("v")} END
        WHEN intent IN ('narrative', 'news_context') THEN 'sections of ' || corp END AS a FROM f)
      SELECT qid, intent, coalesce(a, '{answers.NOTHING}') AS answer, CASE WHEN a IS NULL THEN 'not_found' ELSE 'answered' END AS status FROM o""",
    "grade_explanations": _LONG + f""" SELECT corp_name, period_year, ratio, position, value, grade, {_LABEL_SQL("grade")} AS label,
      ratio || ': ' || CASE WHEN value IS NULL THEN '{ratios.NO_DATA}' ELSE format('{{:,.2f}}', value) || CASE WHEN ratio IN ({", ".join(repr(n) for n in dims.RATIOS if dims.RATIOS[n][2])}) THEN '%' ELSE '' END END || ' (' || {_LABEL_SQL("grade")} || ')' AS explanation FROM graded""",
    "grade_texts": _LONG + f""", {_SIGNALS_SQL}, c AS (SELECT corp_name, period_year, count(*) FILTER (grade <> 'unknown') AS n FROM graded GROUP BY ALL)
      SELECT c.corp_name, c.period_year, CASE WHEN n = 0 THEN '{ratios.NO_DATA}' ELSE 'profitability ' || {_LABEL_SQL("a.g")} || ', stability ' || {_LABEL_SQL("b.g")} || CASE WHEN len(notes) > 0 THEN ': ' || array_to_string(notes[1:3], '; ') ELSE '' END END AS summary
      FROM c JOIN notes USING (corp_name, period_year) JOIN ({_majority_sql(dims.PROFITABILITY)}) a USING (corp_name, period_year) JOIN ({_majority_sql(dims.STABILITY)}) b USING (corp_name, period_year)""",
}

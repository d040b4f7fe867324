"""Queries on the facts and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, periods, values
from ..functions.text import normalize_account
from ..operators import lookup, metrics, ratios
from ..sources.facts import built, facts, read
from .facts_sql import FACTS_SQL

YEAR = 2000

# The questions of the batch lookup.
QUESTIONS = [
    (1, "NATION_3", "revenue", "IS", 1997, None, None, None, None),
    (2, "NATION_3", "revenue", "IS", 2001, None, None, None, None),
    (3, "NATION_4", "assets", "BS", 1999, None, None, None, None),
    (4, "NATION_5", "net_profit", "IS", 1998, None, None, "HY", None),
    (5, "NATION_5", "net_profit", "IS", 1998, None, None, "2Q", None),
    (6, "NATION_6", "quantity", None, None, None, None, "3Q", "Q"),
    (7, "NATION_7", "cost", "IS", 2001, None, None, "3Q", None),
    (8, "NOWHERE", "cost", "IS", 2001, None, None, None, None),
    (9, "NATION_9", "revenue", "IS", 1996, "P", None, None, None),
    (10, "NATION_10", "equity", "IS", 1996, None, None, None, None),
]
_FIELDS = "qid int, corp_name string, account string, statement string, fiscal_year int, period_cp string, period_type string, period_scope string, period_variant string"


def _sql(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else f"'{v}'"


_QUESTIONS_SQL = ", ".join("(" + ", ".join(map(_sql, q)) + ")" for q in QUESTIONS)


def lookup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.lookup(facts(spark, sf_dir), statement="IS", account="revenue", fiscal_year=1998, period_cp="C", period_scope="FY")
    return found.select("fact_id", "corp_name", "period_year", "value")


def lookup_auto_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.lookup_batch(built(spark, sf_dir), spark.createDataFrame(QUESTIONS, _FIELDS))


def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.first_match(built(spark, sf_dir), dims.YEARLY).select("corp_name", "period_year", "account", "scope", "value", "base_value")


def fact_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = read(spark, sf_dir, "lineitem").select(*cols, "l_quantity")
    return lookup.deduplicated(rows, cols[:2], ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])


def value_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances printed in accounting style and read again."""
    c = read(spark, sf_dir, "customer")
    cents = F.abs(F.round(F.col("c_acctbal") * 100).cast("bigint"))
    text = F.concat(F.format_number(F.expr("abs(cast(round(c_acctbal * 100) as bigint)) div 100"), 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    text = F.when(F.col("c_custkey") % 13 == 0, "-").when(F.col("c_custkey") % 17 == 0, "n/a").when(F.col("c_acctbal") < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)
    return c.select("c_custkey", text.alias("printed")).withColumn("value", values.parse_value(F.col("printed")))


def unit_scale_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    unit = F.element_at(F.array(*[F.lit(x) for x in ("원", "천원", "백만원", "억원")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    whole = F.floor("o_totalprice").cast("bigint")
    amount = values.to_base(whole, unit)
    return o.select("o_orderkey", unit.alias("unit"), amount.alias("amount"), values.format_amount(amount.cast("decimal(28,2)")).alias("display"))


def period_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the facts and some broken ones, taken apart, with a label."""
    odd = spark.createDataFrame([("CFY2025dFQA",), ("PFY2024eTQ",), ("CFY2025x",), ("FY2025dFY",), ("",), (None,)], "period_tag string")
    tags = facts(spark, sf_dir).select("period_tag").distinct().union(odd)
    p = tags.withColumn("p", periods.parse_period_tag(F.col("period_tag")))
    return p.select("period_tag", "p.cp", "p.year", "p.type", "p.scope", "p.variant", periods.period_label(F.col("p.cp"), F.col("p.year"), F.col("p.type"), F.col("p.scope")).alias("label"))


def account_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as printed and their canonical names; every fact's must be the account it is of."""
    rows = facts(spark, sf_dir).groupBy("account_kr", "account_norm").agg(F.count("*").alias("n"))
    return rows.select("account_kr", normalize_account(F.col("account_kr")).alias("normalized"), "account_norm", "n")


def on_facts(operator, *args, **named):
    return lambda spark, sf_dir: operator(built(spark, sf_dir), *args, **named)


def missing_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies and their codes: customers with what they ordered, and those without any."""
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    found = customers.join(orders, "c_custkey", "left").na.drop(subset=["n"])
    lost = customers.join(orders, "c_custkey", "left_anti").withColumn("n", F.lit(0).cast("bigint"))
    return found.unionByName(lost)


def report_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of report by words of their names, counted."""
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("사업보고서", "반기보고서", "분기보고서", "감사보고서")]), (F.col("o_orderkey") % 4 + 1).cast("int")), F.date_format("o_orderdate", " (yyyy.MM)"))
    kind = F.coalesce(periods.report_kind(name), F.lit("Other"))
    p = periods.fiscal_period(name, F.col("o_orderdate"))
    rows = read(spark, sf_dir, "orders").select(kind.alias("kind"), p.alias("p")).select("kind", "p.year", "p.scope")
    return rows.groupBy("kind", "year", "scope").agg(F.count("*").alias("n"))


_RANKED = FACTS_SQL + """, ranked AS (
  SELECT *, value * CASE unit_hint WHEN '천원' THEN 1000 WHEN '백만원' THEN 1000000 ELSE 1 END AS base_value,
    row_number() OVER (PARTITION BY corp_name, account_norm, period_year, period_cp ORDER BY CASE period_scope WHEN 'FY' THEN 0 WHEN '3Q' THEN 1 ELSE 2 END, fact_id) AS rn
  FROM facts WHERE period_scope IN ('FY', '3Q', 'HY') AND (statement = 'BS' OR period_variant IS NULL OR period_variant = 'A')
), best AS (SELECT * FROM ranked WHERE rn = 1 AND period_cp = 'C'
), prior AS (
  SELECT corp_name, account_norm, period_year + 1 AS y, period_scope, value * CASE unit_hint WHEN '천원' THEN 1000 WHEN '백만원' THEN 1000000 ELSE 1 END AS previous
  FROM facts WHERE period_cp = 'P' AND (period_variant IS NULL OR period_variant = 'A')
), yoy AS (
  SELECT b.corp_name, b.account_norm AS account, b.period_year, b.period_scope AS scope, p.period_scope AS previous_scope, b.base_value AS current, previous,
    round((b.base_value - previous) / abs(nullif(previous, 0)) * 100, 2) AS change_pct
  FROM best b LEFT JOIN prior p ON p.corp_name = b.corp_name AND p.account_norm = b.account_norm AND p.y = b.period_year AND p.period_scope = b.period_scope
), moved AS (SELECT *, CASE WHEN change_pct > 0 THEN 'up' WHEN change_pct <= 0 THEN 'down' END AS direction FROM yoy)
"""
_IN = lambda names: "(" + ", ".join(f"'{x}'" for x in names) + ")"
_WIDE = _RANKED + ", wide AS (SELECT corp_name, sector, k, period_year, " + ", ".join(
    f"max(base_value) FILTER (account_norm = '{a}') AS {a}" for a in ratios.INPUTS
) + f" FROM best WHERE account_norm IN {_IN(ratios.INPUTS)} GROUP BY ALL), ratios AS (SELECT corp_name, sector, k, period_year, " + ", ".join(
    f"round({a} / nullif({b}, 0){' * 100' if p else ''}, 6) AS {n}{'_ratio' if n == 'equity' else ''}" for n, (a, b, p, *_) in dims.RATIOS.items()
) + " FROM wide)"
_COL = {n: "equity_ratio" if n == "equity" else n for n in dims.RATIOS}


def _grade_sql(n: str) -> str:
    higher, t = dims.RATIOS[n][3], dims.RATIOS[n][4]
    tests = " ".join(f"WHEN value {'>=' if higher else '<='} {x} THEN '{g}'" for g, x in zip(dims.GRADES, t, strict=False))
    return f"CASE WHEN value IS NULL THEN 'unknown' {'WHEN value < 0 THEN ' + chr(39) + 'danger' + chr(39) if n == 'debt' else ''} {tests} ELSE 'danger' END"


_LONG = _WIDE + ", long AS (" + " UNION ALL ".join(f"SELECT corp_name, sector, k, period_year, '{n}' AS ratio, {i} AS position, {_COL[n]} AS value FROM ratios" for i, n in enumerate(dims.RATIOS)) + (
    "), graded AS (SELECT *, CASE ratio " + " ".join(f"WHEN '{n}' THEN {_grade_sql(n)}" for n in dims.RATIOS) + " END AS grade FROM long)"
)


def _amount_sql(x: str) -> str:
    a = f"abs({x})"
    c = f"({a}::DECIMAL(28,2) * 100)::HUGEINT"
    whole = lambda by: f"format('{{:,}}', (({c} + {by * 50}::HUGEINT) // {by * 100}::HUGEINT)::BIGINT)"
    tenths = f"(({c} + {5 * 10**12}::HUGEINT) // {10**13}::HUGEINT)::BIGINT"
    return (
        f"CASE WHEN {x} IS NULL THEN 'N/A' ELSE CASE WHEN {x} < 0 THEN '-' ELSE '' END || CASE WHEN {a} >= 1e12 THEN format('{{:,}}', {tenths} // 10) || '.' || ({tenths} % 10) || '조원' "
        f"WHEN {a} >= 1e8 THEN {whole(10**8)} || '억원' WHEN {a} >= 1e4 THEN {whole(10**4)} || '만원' ELSE {whole(1)} || '원' END END"
    )


def _majority_sql(names: tuple[str, ...]) -> str:
    return f"SELECT corp_name, period_year, first(grade ORDER BY n DESC, p) AS g FROM (SELECT corp_name, period_year, grade, count(*) AS n, min(position) AS p FROM graded WHERE ratio IN {_IN(names)} GROUP BY ALL) GROUP BY ALL"


QUERIES = {
    "facts_long": facts,
    "fact_dedup_first": fact_dedup_first,
    "schema_info_counts": on_facts(metrics.schema_info),
    "lookup_exact": lookup_exact,
    "lookup_auto_batch": lookup_auto_batch,
    "first_match": first_match,
    "period_parse": period_parse,
    "account_normalize": account_normalize,
    "value_parse": value_parse,
    "unit_scale_format": unit_scale_format,
    "profile_kpis": on_facts(metrics.profile, YEAR),
    "yoy_change": on_facts(metrics.yoy),
    "yoy_unaligned": on_facts(metrics.yoy, aligned=False),
    "company_matrix": on_facts(metrics.company_matrix, YEAR),
    "timeseries": on_facts(metrics.timeseries),
    "ratios": lambda spark, sf_dir: ratios.ratios(built(spark, sf_dir)).drop("sector", "k"),
    "ratio_grades": on_facts(ratios.graded),
    "grade_summary": on_facts(ratios.grade_summary),
    "sector_winners": on_facts(ratios.sector_winners),
    "sector_rank": on_facts(ratios.sector_rank),
    "margin_signals": on_facts(ratios.margin_signals),
    "missing_codes": missing_codes,
    "report_kind": report_kind,
}

ORACLES = {
    "facts_long": FACTS_SQL + "SELECT * FROM facts",
    "fact_dedup_first": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem
      QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) = 1""",
    "schema_info_counts": FACTS_SQL + """SELECT 'all' AS kind, '' AS name, count(*) AS n FROM facts UNION ALL SELECT 'company', corp_name, count(*) FROM facts GROUP BY ALL
      UNION ALL SELECT 'statement', statement || '/' || report_type, count(*) FROM facts WHERE statement IS NOT NULL GROUP BY ALL
      UNION ALL SELECT 'period', period_cp || '/' || period_scope || '/' || period_type, count(*) FROM facts GROUP BY ALL""",
    "lookup_exact": FACTS_SQL + """SELECT fact_id, corp_name, period_year, value FROM facts WHERE statement = 'IS' AND account_norm = 'revenue' AND period_year = 1998
      AND period_cp = 'C' AND period_scope = 'FY' ORDER BY fact_id LIMIT 5""",
    "lookup_auto_batch": FACTS_SQL + f""", q AS (
      SELECT qid, corp, account, st, yr, coalesce(cp, 'C') AS cp, coalesce(pt, CASE WHEN st = 'BS' THEN 'end' WHEN st IS NOT NULL THEN 'during' END) AS pt, sc,
        coalesce(va, CASE WHEN st IN ('IS', 'CF') THEN 'A' END) AS va FROM (VALUES {_QUESTIONS_SQL}) v(qid, corp, account, st, yr, cp, pt, sc, va)
    ), t AS (
      SELECT *, 'FY' AS s2, cp AS c2, va AS v2, 1 AS level FROM q WHERE sc IS NULL UNION ALL SELECT *, 'FY', 'P', va, 2 FROM q WHERE sc IS NULL AND cp = 'C'
      UNION ALL SELECT *, sc, cp, va, 3 FROM q UNION ALL SELECT *, sc, 'P', va, 4 FROM q WHERE cp = 'C' UNION ALL SELECT *, sc, cp, NULL, 5 FROM q WHERE va IS NOT NULL
    ), h AS (
      SELECT qid, level, fact_id, value, unit_hint, count(*) OVER (PARTITION BY qid, level) AS n, row_number() OVER (PARTITION BY qid, level ORDER BY fact_id) AS rn,
        min(level) OVER (PARTITION BY qid) AS least
      FROM t JOIN facts ON corp = corp_name AND account = account_norm AND (st IS NULL OR st = statement) AND (yr IS NULL OR yr = period_year) AND (pt IS NULL OR pt = period_type)
        AND c2 = period_cp AND (s2 IS NULL OR s2 = period_scope) AND (v2 IS NULL OR period_variant IS NULL OR v2 = period_variant)
    )
    SELECT q.qid, CASE WHEN level IS NULL THEN 'not_found' WHEN level = 5 THEN 'partial_match' ELSE CASE WHEN n = 1 THEN 'exact' ELSE 'multiple' END
      || CASE level WHEN 1 THEN '_fy_inferred' WHEN 2 THEN '_past_fy' WHEN 4 THEN '_past' ELSE '' END END AS status, coalesce(n, 0) AS n_found, fact_id, value, unit_hint
    FROM q LEFT JOIN (SELECT * FROM h WHERE level = least AND rn <= 5) x ON x.qid = q.qid""",
    "first_match": _RANKED + f"SELECT corp_name, period_year, account_norm AS account, period_scope AS scope, value, base_value FROM best WHERE account_norm IN {_IN(dims.YEARLY)}",
    "period_parse": FACTS_SQL + r""", tags AS (SELECT DISTINCT period_tag AS t FROM facts UNION ALL VALUES ('CFY2025dFQA'), ('PFY2024eTQ'), ('CFY2025x'), ('FY2025dFY'), (''), (NULL)
    ), p AS (SELECT t, nullif(regexp_extract(t, '^([CP])FY(\d{4})', 1), '') AS cp, nullif(regexp_extract(t, '^([CP])FY(\d{4})', 2), '')::INTEGER AS year,
        regexp_extract(t, '^([CP])FY(\d{4})([ed])(FY|HY|FQ|SQ|TQ|[1-4]Q)([AQ])?$', ['a', 'b', 'type', 'scope', 'variant']) AS f FROM tags
    ), s AS (SELECT t, cp, year, CASE f.type WHEN 'e' THEN 'end' WHEN 'd' THEN 'during' END AS type,
        CASE f.scope WHEN 'FQ' THEN '1Q' WHEN 'SQ' THEN '2Q' WHEN 'TQ' THEN '3Q' WHEN '' THEN NULL ELSE f.scope END AS scope, nullif(f.variant, '') AS variant FROM p)
    SELECT t AS period_tag, cp, year, type, scope, variant, year || '년 ' || CASE scope WHEN 'FY' THEN '연간' WHEN 'HY' THEN '반기' ELSE scope[1] || '분기' END
      || CASE type WHEN 'end' THEN ' 말' ELSE ' 누적' END || CASE WHEN cp = 'P' THEN ' (전기)' ELSE '' END AS label FROM s""",
    "account_normalize": FACTS_SQL + "SELECT account_kr, account_norm AS normalized, account_norm, count(*) AS n FROM facts GROUP BY account_kr, account_norm",
    "value_parse": """WITH c AS (SELECT c_custkey, c_acctbal AS b, abs(round(c_acctbal * 100)::BIGINT) AS c FROM customer), t AS (
      SELECT c_custkey, b, format('{:,}', c // 100) || '.' || lpad((c % 100)::VARCHAR, 2, '0') AS t FROM c)
      SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN '-' WHEN c_custkey % 17 = 0 THEN 'n/a' WHEN b < 0 THEN '(' || t || ')' ELSE t END AS printed,
        CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 17 <> 0 THEN b END AS value FROM t""",
    "unit_scale_format": f"""WITH o AS (SELECT o_orderkey, ['원', '천원', '백만원', '억원'][(o_orderkey % 4 + 1)::INTEGER] AS unit,
        floor(o_totalprice)::BIGINT * [1, 1000, 1000000, 100000000][(o_orderkey % 4 + 1)::INTEGER] AS amount FROM orders)
      SELECT o_orderkey, unit, amount::BIGINT AS amount, {_amount_sql("amount::DOUBLE")} AS display FROM o""",
    "profile_kpis": _RANKED + f"SELECT corp_name, account, scope, current, {_amount_sql('current')} AS display, change_pct, direction FROM moved WHERE period_year = {YEAR} AND account IN {_IN(dims.PROFILE)}",
    "yoy_change": _RANKED + f"SELECT corp_name, account, period_year, scope, previous_scope, current, previous, change_pct, direction FROM moved WHERE account IN {_IN(dims.YEARLY)}",
    "yoy_unaligned": _RANKED + f"""SELECT b.corp_name, b.account_norm AS account, b.period_year, b.period_scope AS scope, p.period_scope AS previous_scope, b.base_value AS current, p.base_value AS previous,
      round((b.base_value - p.base_value) / abs(nullif(p.base_value, 0)) * 100, 2) AS change_pct, CASE WHEN b.base_value > p.base_value AND change_pct > 0 THEN 'up' WHEN change_pct IS NOT NULL THEN 'down' END AS direction
      FROM best b LEFT JOIN ranked p ON p.rn = 1 AND p.period_cp = 'P' AND p.corp_name = b.corp_name AND p.account_norm = b.account_norm AND p.period_year + 1 = b.period_year
      WHERE b.account_norm IN {_IN(dims.YEARLY)}""",
    "company_matrix": _RANKED + "SELECT corp_name, " + ", ".join(f"max(base_value) FILTER (account_norm = '{a}') AS {a}" for a in dims.COMPARED)
      + f" FROM best WHERE period_year = {YEAR} AND account_norm IN {_IN(dims.COMPARED)} GROUP BY corp_name",
    "timeseries": FACTS_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY corp_name, account_norm, period_year, period_scope ORDER BY period_cp, fact_id) AS rn FROM facts
        WHERE account_norm IN ('revenue', 'operating_profit', 'net_profit') AND (period_variant IS NULL OR period_variant = 'A'))
      SELECT corp_name, account_norm AS account, period_year, period_scope AS scope, period_cp, value * CASE unit_hint WHEN '천원' THEN 1000 WHEN '백만원' THEN 1000000 ELSE 1 END AS amount,
        row_number() OVER (PARTITION BY corp_name, account_norm ORDER BY period_year, CASE period_scope WHEN '1Q' THEN 0 WHEN 'HY' THEN 1 WHEN '3Q' THEN 2 ELSE 4 END)::INTEGER AS position
      FROM r WHERE rn = 1 AND value IS NOT NULL""",
    "ratios": _WIDE + "SELECT corp_name, period_year, " + ", ".join(f"{_COL[n]} AS {n}" for n in dims.RATIOS) + " FROM ratios",
    "ratio_grades": _LONG + "SELECT corp_name, period_year, ratio, position, value, grade FROM graded",
    "grade_summary": _LONG + "SELECT g.corp_name, g.period_year, " + ", ".join(f"count(*) FILTER (grade = '{g}') AS n_{g}" for g in dims.GRADES)
      + f", count(*) FILTER (grade <> 'unknown') AS n_graded, any_value(a.g) AS profitability, any_value(b.g) AS stability FROM graded g JOIN ({_majority_sql(dims.PROFITABILITY)}) a USING (corp_name, period_year) JOIN ({_majority_sql(dims.STABILITY)}) b USING (corp_name, period_year) GROUP BY g.corp_name, g.period_year",
    "sector_winners": _LONG + """SELECT sector, period_year, ratio, first(corp_name ORDER BY CASE ratio WHEN 'debt' THEN -value ELSE value END DESC, k) AS winner,
      first(value ORDER BY CASE ratio WHEN 'debt' THEN -value ELSE value END DESC, k) AS value, count(*) AS n_companies FROM long WHERE value IS NOT NULL GROUP BY ALL""",
    "sector_rank": _WIDE + "SELECT sector, corp_name, period_year, round(list_avg(list_filter([operating_margin, net_margin, roe, roa], lambda x: x IS NOT NULL)), 4) AS composite, " + ", ".join(
        f"CASE WHEN {n} IS NOT NULL THEN row_number() OVER (PARTITION BY sector, period_year ORDER BY {n} DESC NULLS LAST, k) || '/' || count({n}) OVER (PARTITION BY sector, period_year) END AS rank_{n}" for n in ("operating_margin", "roe", "roa")
      ) + " FROM ratios",
    "margin_signals": _LONG + """SELECT r.corp_name, r.period_year, array_to_string(list_filter([
        CASE WHEN g.n = 2 AND operating_margin IS NOT NULL THEN 'leverage warning' END, CASE WHEN operating_margin - net_margin > 5 THEN 'non-operating loss' END,
        CASE WHEN net_margin - operating_margin > 3 THEN 'one-off gain' END, CASE WHEN s.c > 0 AND p.c < 0 THEN 'margin pressure' END,
        CASE WHEN s.c < 0 AND p.c > 0 THEN 'cost efficiency' END, CASE WHEN s.c > 5 AND p.c > s.c THEN 'strong growth' END], lambda x: x IS NOT NULL), '; ') AS signals
      FROM ratios r LEFT JOIN (SELECT corp_name, period_year, change_pct AS c FROM yoy WHERE account = 'revenue') s USING (corp_name, period_year)
      LEFT JOIN (SELECT corp_name, period_year, change_pct AS c FROM yoy WHERE account = 'operating_profit') p USING (corp_name, period_year)
      LEFT JOIN (SELECT corp_name, period_year, count(*) AS n FROM graded WHERE (ratio = 'roe' AND grade = 'excellent') OR (ratio = 'debt' AND grade IN ('warning', 'danger')) GROUP BY ALL) g USING (corp_name, period_year)""",
    "missing_codes": """SELECT c_custkey, c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""",
    "report_kind": """SELECT CASE o_orderkey % 4 WHEN 0 THEN 'A001' WHEN 1 THEN 'A002' WHEN 2 THEN 'A003' ELSE 'Other' END AS kind, year(o_orderdate)::INTEGER AS year,
      CASE month(o_orderdate) WHEN 12 THEN 'FY' WHEN 9 THEN '3Q' WHEN 6 THEN 'HY' WHEN 3 THEN '1Q' ELSE strftime(o_orderdate, '%m') END AS scope, count(*) AS n FROM orders GROUP BY ALL""",
}

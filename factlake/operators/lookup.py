"""Lookups on the facts: exact, with progressive fallback, and first match by priority.

Each answers a whole batch of questions in one job: what a row store does in up to dozens of
point queries per company is one join with a small table of candidates and one window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import ALIASES, SCOPES, STATEMENTS
from ..functions.values import to_base

#: Fields that a lookup may ask for, and the column of each.
FIELDS = {
    "corp_name": "corp_name",
    "statement": "statement",
    "report_type": "report_type",
    "account": "account_norm",
    "fiscal_year": "period_year",
    "period_cp": "period_cp",
    "period_type": "period_type",
    "period_scope": "period_scope",
    "period_variant": "period_variant",
}


def lookup(facts: DataFrame, limit: int = 5, **wanted) -> DataFrame:
    """Facts that equal every given field (those left out or falsy ask nothing), by fact_id."""
    tests = [F.col(FIELDS[k]) == v for k, v in wanted.items() if v]
    return facts.where(reduce(lambda a, b: a & b, tests, F.lit(True))).orderBy("fact_id").limit(limit)


def variant_is(variant: Column) -> Column:
    """Flows of a whole year carry no variant, so a wanted variant accepts its absence."""
    return variant.isNull() | (F.col("period_variant") == variant) | F.col("period_variant").isNull()


#: Fallback levels: name, scope forced, company period forced, variant dropped; in order.
LEVELS = [
    (1, "exact_fy_inferred", "multiple_fy_inferred", "FY", None, False),
    (2, "exact_past_fy", "multiple_past_fy", "FY", "P", False),
    (3, "exact", "multiple", None, None, False),
    (4, "exact_past", "multiple_past", None, "P", False),
    (5, "partial_match", "partial_match", None, None, True),
]


def lookup_batch(facts: DataFrame, questions: DataFrame, limit: int = 5) -> DataFrame:
    """The facts of the first fallback level that has any, for each question.

    questions: qid, corp_name, account, statement, fiscal_year, period_cp, period_type, period_scope,
    period_variant; nulls ask nothing. Balance sheets are instants; flows are cumulative unless a
    variant is given; the current period is meant unless told. Without a scope the year is tried
    first, then the prior period's; then the question as it is, the prior period, and any variant.
    Returns qid, status, n_found (all of the level), fact_id ...; not_found without facts.
    """
    q = questions.withColumn("period_type", F.coalesce("period_type", F.when(F.col("statement") == "BS", "end").when(F.col("statement").isNotNull(), "during")))
    q = q.withColumn("period_variant", F.coalesce("period_variant", F.when(F.col("statement").isin("IS", "CF"), "A")))
    q = q.withColumn("period_cp", F.coalesce("period_cp", F.lit("C")))
    levels = F.array(
        *[
            F.struct(F.lit(n).alias("level"), F.lit(one).alias("one"), F.lit(many).alias("many"), F.lit(scope).cast("string").alias("scope"), F.lit(cp).cast("string").alias("cp"), F.lit(drop).alias("drop"))
            for n, one, many, scope, cp, drop in LEVELS
        ]
    )
    t = q.select(*[F.col(c).alias(f"q_{c}") for c in q.columns], F.explode(levels).alias("l"))
    t = t.where("(l.level > 2 or q_period_scope is null) and (l.cp is null or q_period_cp = 'C') and (l.level <> 5 or q_period_variant is not null)")
    t = t.select("q_qid", "q_corp_name", "q_account", "q_statement", "q_fiscal_year", "q_period_type", "l.level", "l.one", "l.many",
                 F.coalesce("l.cp", "q_period_cp").alias("q_cp"), F.coalesce("l.scope", "q_period_scope").alias("q_scope"), F.when(~F.col("l.drop"), F.col("q_period_variant")).alias("q_variant"))
    same = lambda want, have: F.col(want).isNull() | (F.col(want) == F.col(have))
    match = (
        (F.col("q_corp_name") == F.col("corp_name"))
        & (F.col("q_account") == F.col("account_norm"))
        & same("q_statement", "statement")
        & same("q_fiscal_year", "period_year")
        & same("q_period_type", "period_type")
        & (F.col("q_cp") == F.col("period_cp"))
        & same("q_scope", "period_scope")
        & variant_is(F.col("q_variant"))
    )
    per = Window.partitionBy("qid")
    hits = facts.join(t, match).withColumnRenamed("q_qid", "qid").withColumn("least", F.min("level").over(per)).where("level = least")
    hits = hits.withColumn("n_found", F.count("*").over(per)).withColumn("rn", F.row_number().over(per.orderBy("fact_id"))).where(F.col("rn") <= limit)
    hits = hits.withColumn("status", F.when(F.col("n_found") == 1, F.col("one")).otherwise(F.col("many")))
    out = questions.select("qid").join(hits.select("qid", "status", "n_found", "fact_id", "value", "unit_hint"), "qid", "left")
    return out.select("qid", F.coalesce("status", F.lit("not_found")).alias("status"), F.coalesce("n_found", F.lit(0)).alias("n_found"), "fact_id", "value", "unit_hint")


def candidates(facts: DataFrame, accounts: tuple[str, ...], scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """A row per account, scope and spelling, with the priority of the last two."""
    rows = [(a, STATEMENTS[a], s, name, i, j) for a in accounts for i, s in enumerate(scopes) for j, name in enumerate((a, *ALIASES.get(a, ())))]
    schema = "account string, c_statement string, c_scope string, c_name string, scope_rank int, alias_rank int"
    return facts.sparkSession.createDataFrame(rows, schema)


def first_match(facts: DataFrame, accounts: tuple[str, ...], cp: str = "C", scopes: tuple[str, ...] = SCOPES, report_type: str = "연결") -> DataFrame:
    """corp_name, sector, k, period_year, account, scope, value, unit_hint, base_value: for each
    company, account and year the fact of the first scope, then spelling, that has one.

    The table of candidates has a few rows per account and is broadcast; one window does the rest.
    """
    dim = candidates(facts, accounts, scopes)
    own = facts.where((F.col("period_cp") == cp) & (F.col("report_type") == report_type))
    own = own.join(F.broadcast(dim), (F.col("account_norm") == F.col("c_name")) & (F.col("period_scope") == F.col("c_scope")) & (F.col("statement") == F.col("c_statement")))
    own = own.where((F.col("statement") == "BS") | F.col("period_variant").isNull() | (F.col("period_variant") == "A"))
    order = Window.partitionBy("corp_name", "account", "period_year").orderBy("scope_rank", "alias_rank", "fact_id")
    own = own.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return own.select("corp_name", "sector", "k", "period_year", "account", F.col("period_scope").alias("scope"), "value", "unit_hint", to_base(F.col("value"), F.col("unit_hint")).alias("base_value"))


def deduplicated(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated order; unlike dropDuplicates, always the same one."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")

"""Measures of companies over accounts and years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import COMPARED, PROFILE, SERIES_ORDER, YEARLY
from ..functions.values import change_percent, format_amount, to_base
from .lookup import first_match


def _direction(change):
    return F.when(change.isNull(), None).when(change > 0, "up").otherwise("down")


def yoy(facts: DataFrame, accounts: tuple[str, ...] = YEARLY, aligned: bool = True) -> DataFrame:
    """Current value, prior value and change in percent of every account, company and year.

    aligned: the prior figure is that of the current one's scope, as the current filing reports it;
    otherwise each side takes its own first scope. A change of zero counts as down, as none is up.
    """
    now = first_match(facts, accounts)
    if aligned:
        before = facts.where("period_cp = 'P' and (period_variant is null or period_variant = 'A')").select(
            F.col("corp_name").alias("b_corp"), F.col("account_norm").alias("b_account"), (F.col("period_year") + 1).alias("b_year"), F.col("period_scope").alias("b_scope"),
            to_base(F.col("value"), F.col("unit_hint")).alias("previous"),
        )
        on = (F.col("corp_name") == F.col("b_corp")) & (F.col("account") == F.col("b_account")) & (F.col("period_year") == F.col("b_year")) & (F.col("scope") == F.col("b_scope"))
    else:
        before = first_match(facts, accounts, cp="P").select(
            F.col("corp_name").alias("b_corp"), F.col("account").alias("b_account"), (F.col("period_year") + 1).alias("b_year"), F.col("scope").alias("b_scope"), F.col("base_value").alias("previous")
        )
        on = (F.col("corp_name") == F.col("b_corp")) & (F.col("account") == F.col("b_account")) & (F.col("period_year") == F.col("b_year"))
    out = now.join(before, on, "left").withColumn("change_pct", change_percent(F.col("base_value"), F.col("previous")))
    out = out.withColumn("direction", _direction(F.col("change_pct")))
    return out.select("corp_name", "account", "period_year", "scope", F.col("b_scope").alias("previous_scope"), F.col("base_value").alias("current"), "previous", "change_pct", "direction")


def profile(facts: DataFrame, year: int, accounts: tuple[str, ...] = PROFILE) -> DataFrame:
    """The indicators of every company in a year, as numbers, as text, and against the year before."""
    rows = yoy(facts, accounts).where(F.col("period_year") == year)
    text = format_amount(F.col("current").cast("decimal(28,2)"))
    return rows.select("corp_name", "account", "scope", "current", text.alias("display"), "change_pct", "direction")


def company_matrix(facts: DataFrame, year: int, accounts: tuple[str, ...] = COMPARED) -> DataFrame:
    """A row per company and a column per account; the columns are stated, so no pass finds them."""
    rows = first_match(facts, accounts).where(F.col("period_year") == year)
    return rows.groupBy("corp_name").pivot("account", list(accounts)).agg(F.first("base_value"))


def timeseries(facts: DataFrame, accounts: tuple[str, ...] = ("revenue", "operating_profit", "net_profit")) -> DataFrame:
    """Every cumulative figure by year and scope. A current figure takes precedence over a prior
    one even if it cannot be read; what cannot be read is then left out."""
    rows = facts.where(F.col("account_norm").isin(*accounts)).where("period_variant is null or period_variant = 'A'")
    w = Window.partitionBy("corp_name", "account_norm", "period_year", "period_scope").orderBy("period_cp", "fact_id")
    place = F.lit(99)
    for scope, i in SERIES_ORDER.items():
        place = F.when(F.col("period_scope") == scope, i).otherwise(place)
    kept = rows.withColumn("rn", F.row_number().over(w)).where("rn = 1 and value is not null")
    order = Window.partitionBy("corp_name", "account_norm").orderBy("period_year", "place")
    kept = kept.withColumn("place", place).withColumn("position", F.row_number().over(order))
    return kept.select("corp_name", F.col("account_norm").alias("account"), "period_year", F.col("period_scope").alias("scope"), "period_cp", to_base(F.col("value"), F.col("unit_hint")).alias("amount"), "position")


def schema_info(facts: DataFrame) -> DataFrame:
    """Counts of all facts, by company, by statement and report type, and by kind of period."""
    by = ["corp_name", "statement", "report_type", "period_cp", "period_scope", "period_type"]
    rows = facts.groupingSets([[], by[:1], by[1:3], by[3:]], *by).agg(F.count("*").alias("n"), F.grouping("corp_name").alias("a"), F.grouping("statement").alias("b"), F.grouping("period_cp").alias("c"))
    kind = F.when(F.col("a") == 0, "company").when(F.col("b") == 0, "statement").when(F.col("c") == 0, "period").otherwise("all")
    name = F.when(kind == "company", F.col("corp_name")).when(kind == "statement", F.concat_ws("/", *by[1:3])).when(kind == "period", F.concat_ws("/", *by[3:])).otherwise("")
    return rows.where((F.col("b") == 1) | F.col("statement").isNotNull()).select(kind.alias("kind"), name.alias("name"), "n")

"""The long table of facts, from order lines and customers.

A nation plays the company, a region the sector; see facts() for the columns. Amounts are summed
as whole millionths, so that results do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dims import STATEMENTS
from .shared import written

#: Printed labels of the accounts.
LABELS = {
    "revenue": "Net sales",
    "cost": "Cost of sales",
    "operating_profit": "Operating profit",
    "net_profit": "Net profit",
    "quantity": "Quantity sold",
    "assets": "Total assets",
    "liabilities": "Total liabilities",
    "equity": "Total equity",
    "current_assets": "Current assets",
    "current_liabilities": "Current liabilities",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def _by_name(**amounts: Column) -> Column:
    return F.create_map(*[x for name, v in amounts.items() for x in (F.lit(name), v.cast("decimal(38,0)"))])


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corp_name, sector, k (its number): the bridge between companies and sectors."""
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("k"), F.col("n_name").alias("corp_name"), F.col("r_name").alias("sector")
    )


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, y, q and the flows of each company's quarter, in millionths.

    Orders and lines meet in one shuffle on the order key; suppliers are joined as Spark sees fit.
    """
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q"))
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", _whole("l_extendedprice").alias("ep"), _whole("l_discount").alias("d"), _whole("l_tax").alias("t"), _whole("l_quantity").alias("n")
    )
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"))
    rows = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).join(orders, lines.l_orderkey == orders.o_orderkey)
    total = lambda x: F.sum(x.cast("decimal(28,0)"))
    ep, d, t = F.col("ep"), F.col("d"), F.col("t")
    return rows.groupBy("k", "y", "q").agg(
        total(ep * 10000).alias("gross"), total(ep * d * 100).alias("discount"), total(ep * (100 - d) * t).alias("tax"), total(F.col("n") * 10000).alias("quantity")
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_id, corp_name, sector, k, fiscal_year, statement, report_type, account_kr, account_norm,
    period_tag, period_cp, period_year, period_type, period_scope, period_variant, value, value_raw,
    unit_hint.

    Flows: cumulative 1Q, HY, 3Q (variant A) and single quarters (Q); the year (no variant) where all
    four quarters exist. Instants: at the end of every year with orders. Each figure is reported
    again, as the prior one, by the following year's filing, unless (k + that year) % 7 = 0. Cells
    with (k + year) % 11 = 0 are printed as "-"; units go by k % 3.
    """
    w = Window.partitionBy("k", "y").orderBy("q")
    flows = ("gross", "discount", "tax", "quantity")
    # a row per company and quarter, which all that follows reads: order lines are read once
    q = written(quarters(spark, sf_dir), "quarters").coalesce(1)
    running = q.select("k", "y", "q", F.count("*").over(Window.partitionBy("k", "y")).alias("n"), *[F.sum(c).over(w).alias(c) for c in flows])
    single = q.select("k", "y", F.concat(F.col("q").cast("string"), F.lit("Q")).alias("scope"), F.lit("Q").alias("variant"), *flows)
    upto = running.where("q < 4").select("k", "y", F.element_at(F.array(F.lit("1Q"), F.lit("HY"), F.lit("3Q")), F.col("q")).alias("scope"), F.lit("A").alias("variant"), *flows)
    year = running.where("q = 4 and n = 4").select("k", "y", F.lit("FY").alias("scope"), F.lit(None).cast("string").alias("variant"), *flows)
    flow = single.unionByName(upto).unionByName(year)
    g, d, t = F.col("gross"), F.col("discount"), F.col("tax")
    flow = flow.select(
        "k", "y", "scope", "variant", F.lit("during").alias("type"),
        F.explode(_by_name(revenue=g - d, cost=d, operating_profit=g - d - d, net_profit=g - d - d - t, quantity=F.col("quantity"))).alias("account", "v"),
    )
    balance = _whole("c_acctbal").cast("decimal(28,0)") * 10000
    half = F.col("c_custkey") % 2 == 0
    own = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(
        F.sum(F.greatest(balance, F.lit(0))).alias("a"),
        F.sum(F.greatest(-balance, F.lit(0))).alias("l"),
        F.sum(F.when(half, F.greatest(balance, F.lit(0))).otherwise(0)).alias("ca"),
        F.sum(F.when(half, F.greatest(-balance, F.lit(0))).otherwise(0)).alias("cl"),
    )
    accounts = _by_name(assets=F.col("a"), liabilities=F.col("l"), equity=F.col("a") - F.col("l"), current_assets=F.col("ca"), current_liabilities=F.col("cl"))
    stock = q.select("k", "y").distinct().join(own, "k").select("k", "y", F.lit("FY").alias("scope"), F.lit(None).cast("string").alias("variant"), F.lit("end").alias("type"), F.explode(accounts).alias("account", "v"))
    current = flow.unionByName(stock)
    current = current.withColumn("cp", F.lit("C")).withColumn("filed", F.col("y"))
    filed = q.select("k", F.col("y").alias("filed")).distinct()
    prior = current.where("(k + y + 1) % 7 <> 0").drop("filed").withColumn("cp", F.lit("P")).join(filed, [current.k == filed.k, current.y + 1 == filed.filed], "inner").drop(filed.k)
    rows = current.unionByName(prior).join(companies(spark, sf_dir), "k")
    scale = F.element_at(F.array(F.lit(1), F.lit(1000), F.lit(1000000)), (F.col("k") % 3 + 1).cast("int")).cast("bigint")
    rows = rows.withColumn("step", (scale * 10000).cast("bigint")).withColumn("cents", F.expr("cast((abs(v) + step div 2) div step as bigint)"))
    printed = F.concat(F.format_number(F.expr("cents div 100"), 0), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    printed = F.when(F.col("v") < 0, F.concat(F.lit("("), printed, F.lit(")"))).otherwise(printed)
    blank = (F.col("k") + F.col("y")) % 11 == 0
    label, statement = F.lit(None), F.lit(None)
    for account, text in LABELS.items():
        label = F.when(F.col("account") == account, text).otherwise(label)
        statement = F.when(F.col("account") == account, STATEMENTS[account]).otherwise(statement)
    tag = F.concat("cp", F.lit("FY"), F.col("y").cast("string"), F.when(F.col("type") == "end", "e").otherwise("d"), "scope", F.coalesce("variant", F.lit("")))
    return rows.select(
        F.concat_ws("|", "corp_name", F.col("filed").cast("string"), "account", tag).alias("fact_id"),
        "corp_name",
        "sector",
        F.col("k").cast("int").alias("k"),
        F.col("filed").cast("int").alias("fiscal_year"),
        statement.alias("statement"),
        F.lit("연결").alias("report_type"),
        F.concat(label, F.when(F.col("k") % 2 == 1, F.concat(F.lit(" (주"), F.col("k").cast("string"), F.lit(")"))).otherwise("")).alias("account_kr"),
        F.col("account").alias("account_norm"),
        tag.alias("period_tag"),
        F.col("cp").alias("period_cp"),
        F.col("y").cast("int").alias("period_year"),
        F.col("type").alias("period_type"),
        F.col("scope").alias("period_scope"),
        F.col("variant").alias("period_variant"),
        F.when(~blank, F.when(F.col("v") < 0, -F.col("cents")).otherwise(F.col("cents")) / F.lit(100.0)).alias("value"),
        F.when(blank, "-").otherwise(printed).alias("value_raw"),
        F.element_at(F.array(F.lit("원"), F.lit("천원"), F.lit("백만원")), (F.col("k") % 3 + 1).cast("int")).alias("unit_hint"),
    )


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """facts() as a table. It has a few dozen rows per company and year, whatever the orders."""
    return written(facts(spark, sf_dir), "facts")


#: The sector that holds every company, and questions suggested by sector; others get the last.
EVERYTHING = "ALL"
SUGGESTED = {"ASIA": ("{s} revenue rank", "{s} margins"), "EUROPE": ("{s} debt rank",), None: ("{s} compared",)}


def sector_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sector, corp_name, ordinal: each company under EVERYTHING and under its own sector."""
    own = companies(spark, sf_dir)
    sectors = F.array(F.struct(F.lit(EVERYTHING).alias("sector"), F.lit(0).alias("ordinal")), F.struct("sector", F.lit(1).alias("ordinal")))
    return own.select("corp_name", F.explode(sectors).alias("s")).select("s.sector", "corp_name", "s.ordinal")


def sector_of(bridge: DataFrame) -> DataFrame:
    """corp_name and the first sector that lists it, EVERYTHING aside."""
    return bridge.where(F.col("sector") != EVERYTHING).groupBy("corp_name").agg(F.min_by("sector", F.struct("ordinal", "sector")).alias("sector"))


def aliased(rows: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """rows with `name` replaced by what it is an alias of, exactly or else in small letters; kept
    where it is none. aliases: alias, stands_for; a list of names, broadcast."""
    exact = aliases.select(F.col("alias").alias("_a"), F.col("stands_for").alias("_x"))
    lower = aliases.groupBy(F.lower("alias").alias("_l")).agg(F.min("stands_for").alias("_y"))
    out = rows.join(F.broadcast(exact), F.col(name) == F.col("_a"), "left").join(F.broadcast(lower), F.lower(name) == F.col("_l"), "left")
    return out.withColumn(name, F.coalesce("_x", "_y", name)).drop("_a", "_x", "_l", "_y")


def suggested(sectors: DataFrame) -> DataFrame:
    """sector, position, question: those of the sector, else the general ones."""
    lists = F.lit(None).cast("array<string>")
    for s, texts in SUGGESTED.items():
        if s is not None:
            lists = F.when(F.col("sector") == s, F.array(*map(F.lit, texts))).otherwise(lists)
    lists = F.coalesce(lists, F.array(*map(F.lit, SUGGESTED[None])))
    rows = sectors.select("sector", F.posexplode(lists).alias("position", "text"))
    return rows.select("sector", "position", F.replace("text", F.lit("{s}"), F.col("sector")).alias("question"))

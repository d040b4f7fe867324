"""Financial ratios, their grades, and what they say together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dims import GRADES, PROFITABILITY, RATIOS, STABILITY
from ..functions.values import ratio
from .lookup import first_match
from .metrics import yoy

INPUTS = tuple(dict.fromkeys(x for a, b, *_ in RATIOS.values() for x in (a, b)))


def ratios(facts: DataFrame) -> DataFrame:
    """corp_name, sector, k, period_year and a column per ratio; percentages are times 100.

    All inputs come from one first-match pass and one conditional aggregate.
    """
    rows = first_match(facts, INPUTS)
    wide = rows.groupBy("corp_name", "sector", "k", "period_year").agg(*[F.max(F.when(F.col("account") == a, F.col("base_value"))).alias(f"_{a}") for a in INPUTS])
    value = lambda a, b, percent: ratio(F.col(f"_{a}"), F.col(f"_{b}")) * (100 if percent else 1)
    return wide.select("corp_name", "sector", "k", "period_year", *[F.round(value(a, b, p), 6).alias(name) for name, (a, b, p, *_) in RATIOS.items()])


def grade(name: str, value: Column, legacy_debt: bool = False) -> Column:
    """The first threshold that the ratio meets. Negative equity makes a negative debt ratio, which
    meets "at most one"; that is graded danger, unless legacy_debt."""
    _, _, _, higher, thresholds = RATIOS[name]
    out = F.when(value.isNull(), "unknown")
    if name == "debt" and not legacy_debt:
        out = out.when(value < 0, "danger")
    for g, t in zip(GRADES, thresholds, strict=False):
        out = out.when(value >= t if higher else value <= t, g)
    return out.otherwise(GRADES[-1])


def graded(facts: DataFrame) -> DataFrame:
    """Ratios as rows: corp_name, period_year, ratio, position in the list, value, grade."""
    wide = ratios(facts)
    items = F.array(*[F.struct(F.lit(n).alias("ratio"), F.lit(i).alias("position"), F.col(n).alias("value"), grade(n, F.col(n)).alias("grade")) for i, n in enumerate(RATIOS)])
    return wide.select("corp_name", "period_year", F.explode(items).alias("x")).select("corp_name", "period_year", "x.*")


def majority(rows: DataFrame, names: tuple[str, ...], out: str) -> DataFrame:
    """The most frequent grade of these ratios; of equally frequent ones that met first."""
    counted = rows.where(F.col("ratio").isin(*names)).groupBy("corp_name", "period_year", "grade").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    best = F.max_by("grade", F.struct("n", -F.col("first")))
    return counted.groupBy("corp_name", "period_year").agg(best.alias(out))


def grade_summary(facts: DataFrame) -> DataFrame:
    """Per company and year: the two majority grades, grade counts (unknown ones aside)."""
    rows = graded(facts)
    counts = rows.groupBy("corp_name", "period_year").agg(*[F.count_if(F.col("grade") == g).alias(f"n_{g}") for g in GRADES], F.count_if(F.col("grade") != "unknown").alias("n_graded"))
    both = ["corp_name", "period_year"]
    return counts.join(majority(rows, PROFITABILITY, "profitability"), both).join(majority(rows, STABILITY, "stability"), both)


def margin_signals(facts: DataFrame) -> DataFrame:
    """Comments that a company's year calls for, in their order, joined by "; "."""
    r = ratios(facts)
    change = yoy(facts, ("revenue", "operating_profit")).groupBy("corp_name", "period_year").agg(
        F.max(F.when(F.col("account") == "revenue", F.col("change_pct"))).alias("sales"), F.max(F.when(F.col("account") == "operating_profit", F.col("change_pct"))).alias("profit")
    )
    r = r.join(change, ["corp_name", "period_year"], "left")
    gap = F.col("operating_margin") - F.col("net_margin")
    risky = grade("roe", F.col("roe")).eqNullSafe("excellent") & grade("debt", F.col("debt")).isin("warning", "danger") & F.col("operating_margin").isNotNull()
    notes = [
        (risky, "leverage warning"),
        (gap > 5, "non-operating loss"),
        (-gap > 3, "one-off gain"),
        ((F.col("sales") > 0) & (F.col("profit") < 0), "margin pressure"),
        ((F.col("sales") < 0) & (F.col("profit") > 0), "cost efficiency"),
        ((F.col("sales") > 5) & (F.col("profit") > F.col("sales")), "strong growth"),
    ]
    return r.select("corp_name", "period_year", F.array_join(F.array_compact(F.array(*[F.when(c, t) for c, t in notes])), "; ").alias("signals"))


def sector_winners(facts: DataFrame) -> DataFrame:
    """The best company of each sector, year and ratio; low is best for debt; ties go to the first."""
    wide = ratios(facts)
    items = F.array(*[F.struct(F.lit(n).alias("ratio"), F.col(n).alias("value"), (F.col(n) * (1 if RATIOS[n][3] else -1)).alias("score")) for n in RATIOS])
    rows = wide.select("corp_name", "sector", "k", "period_year", F.explode(items).alias("x")).select("*", "x.*").where("value is not null")
    best = rows.groupBy("sector", "period_year", "ratio").agg(F.max_by(F.struct("corp_name", "value"), F.struct("score", -F.col("k"))).alias("w"), F.count("*").alias("n_companies"))
    return best.select("sector", "period_year", "ratio", F.col("w.corp_name").alias("winner"), F.col("w.value").alias("value"), "n_companies")


def sector_rank(facts: DataFrame, names: tuple[str, ...] = ("operating_margin", "roe", "roa")) -> DataFrame:
    """Each company's place among those of its sector with a value, as "i/n", and its composite
    profitability: the mean of what it has of the four ratios."""
    wide = ratios(facts)
    have = F.array_compact(F.array(*[F.col(n) for n in ("operating_margin", "net_margin", "roe", "roa")]))
    total = F.aggregate(have, F.lit(0.0), lambda a, x: a + x)
    out = [F.round(F.try_divide(total, F.size(have)), 4).alias("composite")]
    for n in names:
        w = Window.partitionBy("sector", "period_year")
        place = F.row_number().over(w.orderBy(F.col(n).desc_nulls_last(), "k"))
        text = F.concat(place.cast("string"), F.lit("/"), F.count(n).over(w).cast("string"))
        out.append(F.when(F.col(n).isNotNull(), text).alias(f"rank_{n}"))
    return wide.select("sector", "corp_name", "period_year", *out)


# What grades are called, and what a company's two majority grades make of it.
GRADE_LABELS = {"excellent": "very good", "good": "good", "fair": "average", "warning": "needs care", "danger": "critical", "unknown": "no data"}
NO_DATA = "no data"


def explained(facts: DataFrame) -> DataFrame:
    """graded() with the grade's label and a sentence that names ratio, value and label."""
    label = F.lit(NO_DATA)
    for g, text in GRADE_LABELS.items():
        label = F.when(F.col("grade") == g, text).otherwise(label)
    value = F.when(F.col("value").isNull(), NO_DATA).otherwise(F.concat(F.format_number(F.col("value").cast("decimal(28,6)"), 2), F.when(F.col("ratio").isin([n for n in RATIOS if RATIOS[n][2]]), "%").otherwise("")))
    return graded(facts).withColumn("label", label).withColumn("explanation", F.concat("ratio", F.lit(": "), value, F.lit(" ("), label, F.lit(")")))


def summaries(facts: DataFrame) -> DataFrame:
    """corp_name, period_year, summary: both majority grades in words and up to three comments."""
    label = lambda c: F.coalesce(*[F.when(F.col(c) == g, text) for g, text in GRADE_LABELS.items()], F.lit(NO_DATA))
    both = ["corp_name", "period_year"]
    rows = grade_summary(facts).join(margin_signals(facts), both)
    notes = F.array_join(F.slice(F.split("signals", "; "), 1, 3), "; ")
    text = F.concat(F.lit("profitability "), label("profitability"), F.lit(", stability "), label("stability"), F.when(notes != "", F.concat(F.lit(": "), notes)).otherwise(""))
    return rows.select(*both, F.when(F.col("n_graded") == 0, NO_DATA).otherwise(text).alias("summary"))

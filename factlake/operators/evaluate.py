"""Scores of answers, summed up by system and category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import answer_status, keyword_coverage, number_match


def scored(answers: DataFrame) -> DataFrame:
    """answers (system, id, category, truth, answer) with status, number_ok and coverage; a score
    that does not apply is null, so aggregates leave it out."""
    return answers.withColumns(
        {
            "status": answer_status(F.col("answer")),
            "number_ok": number_match(F.col("truth"), F.col("answer")),
            "coverage": keyword_coverage(F.col("truth"), F.col("answer")),
        }
    )


def answer_rates(rows: DataFrame) -> DataFrame:
    """Answered share by category and system, with a total over categories."""
    out = rows.rollup("system", "category").agg(F.count_if(F.col("status") == "answered").alias("ok"), F.count("*").alias("n"), F.grouping("category").alias("g"))
    rate = F.round(F.col("ok").cast("decimal(18,0)") * 100 / F.col("n"), 1).cast("double")
    return out.where("system is not null").select("system", F.when(F.col("g") == 1, "total").otherwise(F.col("category")).alias("category"), "ok", "n", rate.alias("pct"))


def metric_summary(rows: DataFrame) -> DataFrame:
    """Mean, sample deviation and number of valid scores of each metric and system."""
    score = F.array(F.struct(F.lit("number").alias("metric"), F.col("number_ok").cast("int").cast("decimal(18,6)").alias("v")), F.struct(F.lit("coverage").alias("metric"), F.col("coverage").cast("decimal(18,6)").alias("v")))
    long = rows.select("system", F.explode(score).alias("s")).select("system", "s.metric", "s.v")
    # sums of decimals do not depend on the order of rows; the deviation follows from them
    t = long.groupBy("system", "metric").agg(F.count("v").alias("n"), F.sum("v").cast("double").alias("s"), F.sum((F.col("v") * F.col("v")).cast("decimal(28,12)")).cast("double").alias("ss"))
    mean = F.try_divide(F.col("s"), F.col("n"))
    deviation = F.when(F.col("n") > 1, F.sqrt(F.greatest((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0))))
    return t.select("system", "metric", F.col("n").alias("n_valid"), F.round(mean, 6).alias("mean"), F.round(deviation, 6).alias("std"))


def intent_correct(truth_number: Column, intent: Column) -> Column:
    """Whether the intent suits the truth: a fact where it has a number, narrative where not, hybrid always."""
    number = truth_number.isNotNull()
    right = (number & (intent == "fact_lookup")) | (~number & (intent == "narrative")) | (intent == "hybrid")
    return F.when(F.coalesce(right, F.lit(False)), 1).otherwise(0)


def _ratio(part: Column, whole: Column, digits: int) -> Column:
    """part / whole for sums of whole numbers or decimals, rounded; null of nothing."""
    return F.round(F.try_divide(part.cast("decimal(28,6)"), whole.cast("decimal(18,0)")), digits).cast("double")


def summary(rows: DataFrame) -> DataFrame:
    """One row per system of scored() rows with intent, intent_correct and elapsed (whole numbers):
    counts by intent, accuracy of facts, coverage of narratives, right intents, mean time."""
    of = lambda intent, value: F.when(F.col("intent") == intent, value)
    number, coverage = of("fact_lookup", F.col("number_ok").cast("int")), of("narrative", F.col("coverage").cast("decimal(18,6)"))
    counts = [F.count_if(F.col("intent") == i).alias(f"{i}_n") for i in ("fact_lookup", "narrative", "hybrid")]
    return rows.groupBy("system").agg(
        F.count("*").alias("total"),
        *counts,
        _ratio(F.sum(number), F.count(number), 3).alias("fact_accuracy"),
        _ratio(F.sum(coverage), F.count(coverage), 3).alias("narrative_coverage"),
        _ratio(F.sum("intent_correct"), F.count("*"), 3).alias("intent_accuracy"),
        _ratio(F.sum("elapsed"), F.count("elapsed"), 2).alias("mean_elapsed"),
    )


def fact_accuracy(rows: DataFrame) -> DataFrame:
    """system, category (and their total), n, correct, pct: of answers whose truth has a number."""
    scorable = rows.where("number_ok is not null")
    out = scorable.rollup("system", "category").agg(F.count("*").alias("n"), F.sum(F.col("number_ok").cast("int")).alias("correct"), F.grouping("category").alias("g"))
    pct = F.round(F.col("correct").cast("decimal(18,0)") * 100 / F.col("n"), 0).cast("bigint")
    return out.where("system is not null").select("system", F.when(F.col("g") == 1, "total").otherwise(F.col("category")).alias("category"), "n", "correct", pct.alias("pct"))


def distribution(rows: DataFrame, *fields: str) -> DataFrame:
    """field, value, n of each field, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return rows.select(pairs.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def side_by_side(answers: DataFrame, systems: tuple[str, ...]) -> DataFrame:
    """id, category and a column of statuses per system: results meet by id, not by their place."""
    return answers.groupBy("id", "category").pivot("system", list(systems)).agg(F.first("status"))


def summary_json(rows: DataFrame) -> DataFrame:
    """system and its summary as JSON."""
    return rows.select("system", F.to_json(F.struct(*[c for c in rows.columns if c != "system"])).alias("summary"))

"""Questions to answers without a model: dispatch by intent, templates, merging with a port's answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import format_amount, to_base

#: Intents with a handler of their own; any other is handled as narrative.
HANDLED = ("fact_lookup", "narrative", "hybrid", "definition", "sector_compare", "news_context", "general")
#: From this confidence on, the rules' reading of a question needs no other.
SURE = 0.6
# Answers.
NOTHING = "not found"
FOUND = "{corp} {period} {account}: {amount}"


def reclassified(intent: Column, remembered: Column, corp: Column, account: Column) -> Column:
    """After memory gave a general question its company: a fact if it names an account, else narrative."""
    late = remembered & (intent == "general") & corp.isNotNull()
    return F.when(late & account.isNotNull(), "fact_lookup").when(late, "narrative").otherwise(intent)


def dispatched(intent: Column) -> Column:
    return F.when(intent.isin(*HANDLED), intent).otherwise("narrative")


def merged(rules: DataFrame, port: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """rules (qid, intent, confidence, fields) with what a port read where the rules are not SURE:
    it fills fields that are null, and its intent counts. Without an answer of it, rules stay."""
    other = port.select("qid", *[F.col(c).alias(f"_p_{c}") for c in ("intent", *fields)])
    rows = rules.join(other, "qid", "left")
    unsure = F.col("confidence") < SURE
    kept = {f: F.when(unsure, F.coalesce(f, f"_p_{f}")).otherwise(F.col(f)) for f in fields}
    kept["intent"] = F.when(unsure, F.coalesce("_p_intent", "intent")).otherwise(F.col("intent"))
    return rows.withColumns(kept).drop(*[f"_p_{c}" for c in ("intent", *fields)])


def fact_answer(corp: Column, period: Column, account: Column, value: Column, unit: Column) -> Column:
    """FOUND filled in with an amount in readers' units; NOTHING without a value."""
    text = F.lit(FOUND)
    for name, part in (("corp", corp), ("period", period), ("account", account), ("amount", format_amount(to_base(value, unit).cast("decimal(28,2)")))):
        text = F.replace(text, F.lit("{" + name + "}"), part)
    return F.when(value.isNull() | corp.isNull(), NOTHING).otherwise(text)


def answered(questions: DataFrame, handlers: dict[str, DataFrame]) -> DataFrame:
    """qid, intent, answer, status of each question (qid, intent): by its intent's handler (qid, answer).

    All handlers' answers are united and met once by qid and intent, so the batch is one join.
    """
    out = None
    for intent, rows in handlers.items():
        part = rows.select("qid", F.lit(intent).alias("intent"), "answer")
        out = part if out is None else out.unionByName(part)
    asked = questions.select("qid", dispatched(F.col("intent")).alias("intent"))
    answer = F.coalesce("answer", F.lit(NOTHING))
    return asked.join(out, ["qid", "intent"], "left").select("qid", "intent", answer.alias("answer"), F.when(answer == NOTHING, "not_found").otherwise("answered").alias("status"))

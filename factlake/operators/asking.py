"""A batch of questions in dialogues, from their words to answers, in one plan.

Questions are routed by rules, completed from what their session said before, classified again where that
gave them a company, and dealt to handlers by intent; each handler reads its own questions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .answers import answered, dispatched
from .routing import has, intent, route
from .session import complete

# Words that point back to a company, that compare with another period, that mean the year
# before, and that turn to another subject.
PRONOUNS = ("이 회사", "그 회사", "이 기업", "그 기업", "여기", "거기")
COMPARES = ("전년", "전기", "이전", "전 분기", "직전", "지난해", "작년")
BACK = ("전년", "작년", "지난해")
SWITCHES = ("그럼", "그러면", "그리고", "또한", "다음으로")

Handler = Callable[[DataFrame], DataFrame]


def flags(text: Column) -> dict[str, Column]:
    """What the words of a question say about earlier ones; a comparison is no change of subject."""
    return {"pronoun": has(text, PRONOUNS), "compare": has(text, COMPARES), "back": has(text, BACK), "switch": has(text, SWITCHES) & ~has(text, COMPARES)}


def understood(questions: DataFrame, names: dict) -> DataFrame:
    """questions (qid, session, turn, text) with corp, account, statement, sector, term, year, scope, intent
    and used: whether memory changed them. names: as for route(), lists or tables."""
    routed = route(questions.select("qid", "text"), names)
    rows = written(questions.join(routed.drop("confidence", "cp", "type", "variant"), "qid"), "routed")
    said = rows.select("session", "turn", "corp", "year", "account", "scope", "statement", *[c.alias(n) for n, c in flags(F.col("text")).items()])
    done = complete(said)
    new = [F.col(c).alias(f"_{c}") for c in ("corp", "year", "account", "scope", "statement")]
    both = rows.join(done.select(F.col("session").alias("_s"), F.col("turn").alias("_t"), *new), F.col("session").eqNullSafe(F.col("_s")) & (F.col("turn") == F.col("_t")))
    changed = ~(F.col("corp").eqNullSafe(F.col("_corp")) & F.col("year").eqNullSafe(F.col("_year")) & F.col("account").eqNullSafe(F.col("_account")))
    again = intent(F.col("text"), F.col("_corp"), F.col("_account"), F.col("_statement"), F.col("sector"), F.lit(None).cast("string"), F.col("_scope"), F.col("_year"))
    late = changed & (F.col("intent") == "general") & F.col("_corp").isNotNull()
    return both.select(
        "qid", "session", "turn", "text", *[F.col(f"_{c}").alias(c) for c in ("corp", "year", "account", "scope", "statement")], "sector",
        F.when(late, again).otherwise(F.col("intent")).alias("intent"), changed.alias("used"),
    )


def ask_batch(questions: DataFrame, names: dict, handlers: dict[str, Handler]) -> DataFrame:
    """qid, session, turn, corp, account, year, intent, used, answer, status of each question.

    handlers: by intent, from its understood() questions to qid and answer. An intent without a handler, and
    a question that its handler has no answer for, is not found.
    """
    rows = written(understood(questions, names), "understood")
    mine = {name: handle(rows.where(dispatched(F.col("intent")) == name)) for name, handle in handlers.items()}
    found = answered(rows.select("qid", "intent"), mine).select("qid", "answer", "status")
    return rows.join(found, "qid").select("qid", "session", "turn", "corp", "account", "year", "intent", "used", "answer", "status")

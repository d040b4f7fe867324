"""Dialogues: what earlier turns say about later ones, and sessions that end by silence."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def carry(turns: DataFrame, session: str, turn: str, fields: list[str]) -> DataFrame:
    """turns with last_<field>: the last known value from strictly earlier turns of the session."""
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumns({f"last_{f}": F.last(f, ignorenulls=True).over(w) for f in fields})


def last_turns(turns: DataFrame, session: str, turn: str, field: str, n: int = 5) -> DataFrame:
    w = Window.partitionBy(session).orderBy(turn).rowsBetween(-(n - 1), 0)
    return turns.withColumn("history", F.collect_list(field).over(w))


def _streamed(rows: DataFrame, key: str, order: list[str], step, schema: str) -> DataFrame:
    """Rows of each key in order, one after another, through step(row, state) -> (values, state).

    Keys are dealt by hash and sorted; a task streams its batches and carries only the state of the
    key at hand, so a key of any length is never gathered. Numbers that may be null travel as text.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = object(), None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.key != at:
                    at, state = row.key, None
                values, state = step(row, state)
                out.append(values)
            yield pd.DataFrame(out, columns=names)

    sorted_rows = rows.withColumn("key", F.coalesce(F.col(key).cast("string"), F.lit(""))).repartition("key").sortWithinPartitions("key", *order)
    return sorted_rows.mapInPandas(run, schema)


def _complete(x, memory):
    """One question from the memory of its session; x.year and the others are text or None."""
    m = memory or dict.fromkeys(("corp", "year", "account", "scope", "statement"))
    known = m["corp"] is not None
    corp = m["corp"] if known and (x.corp is None or x.pronoun) else x.corp
    rest = not x.compare and not x.switch and x.year is None and x.scope is None
    fill = lambda f, when: m[f] if known and when and getattr(x, f) is None else getattr(x, f)
    year = fill("year", x.compare or x.switch or rest)
    if known and x.year is None and x.compare and x.back and year is not None:
        year = str(int(year) - 1)
    scope = fill("scope", x.compare or x.switch or rest)
    account, statement = fill("account", x.compare), fill("statement", x.compare or x.switch)
    done = {"corp": corp, "year": year, "account": account, "scope": scope, "statement": statement}
    return (x.session, x.turn, *done.values()), {f: v if v is not None else m[f] for f, v in done.items()}


def complete(turns: DataFrame) -> DataFrame:
    """Questions completed from the session's memory, which is filled from completed questions.

    turns: session, turn, corp, year, account, scope, statement, pronoun, compare, back, switch
    (booleans: the question points back, compares, means the year before, changes the subject).
    A missing company is the last one; a pronoun makes it so in any case. A comparison takes the last
    year, less one if it looks back, and the scope, account and statement; a change of subject the
    year, scope and statement; otherwise year and scope are taken if both are missing. Since year-1
    questions build on one another, a session's turns are streamed in order with its memory.
    """
    kind = turns.schema["session"].dataType.simpleString()
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("pronoun", "compare", "back", "switch")]
    rows = turns.select(F.col("session").cast("string").alias("session"), "turn", "corp", F.col("year").cast("string").alias("year"), "account", "scope", "statement", *flags)
    out = _streamed(rows, "session", ["turn", "corp", "year", "account", "scope", "statement"], _complete, "session string, turn int, corp string, year string, account string, scope string, statement string")
    return out.withColumns({"session": F.col("session").cast(kind), "year": F.col("year").cast("int")})


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """key, started, ended, n of runs of events that silence of more than `gap` separates."""
    w = F.session_window(ts, gap)
    rows = events.groupBy(key, w.alias("w")).agg(F.count("*").alias("n"), F.min(ts).alias("started"), F.max(ts).alias("ended"))
    return rows.select(key, "started", "ended", "n")


def cache_hits(events: DataFrame, key: str, ts: str, order: str, ttl_seconds: int) -> DataFrame:
    """Each request with whether a cache answers it. A miss stores the answer for ttl_seconds, a hit
    does not prolong that; so hits depend on the last miss, which is carried along a key's requests."""
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order)}
    micros = F.expr(f"timestampdiff(MICROSECOND, cast('1970-01-01' as {events.schema[ts].dataType.simpleString()}), `{ts}`)")
    rows = events.select(F.col(key).cast("string").alias("of"), F.col(order).alias("id"), micros.alias("at"))

    def step(x, stored_at):
        hit = stored_at is not None and (x.at - stored_at) // 1_000_000 < ttl_seconds
        return (x.of, x.id, hit), stored_at if hit else x.at

    out = _streamed(rows, "of", ["at", "id"], step, f"of string, id {kinds[order]}, hit boolean")
    return out.select(F.col("of").cast(kinds[key]).alias(key), F.col("id").alias(order), "hit")

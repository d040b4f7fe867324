"""Queries that SQL cannot express, and streams, against plain versions."""

import random

from factlake.operators import session
from factlake.operators.chunking import split_text
from factlake.plans.text_queries import chunk_recursive, sections


def plain_complete(turns):
    memory, out = {}, []
    for t in sorted(turns, key=lambda t: (str(t["session"]), t["turn"])):
        m = memory.setdefault(t["session"], {})
        done = {f: t[f] for f in ("corp", "year", "account", "scope", "statement")}
        if m.get("corp") is not None:
            if t["corp"] is None or t["pronoun"]:
                done["corp"] = m["corp"]
            rest = not t["compare"] and not t["switch"] and t["year"] is None and t["scope"] is None
            if (t["compare"] or t["switch"] or rest) and t["year"] is None:
                back = t["compare"] and t["back"]
                done["year"] = None if m.get("year") is None else m["year"] - 1 if back else m["year"]
            for f, when in (("scope", t["compare"] or t["switch"] or rest), ("account", t["compare"]), ("statement", t["compare"] or t["switch"])):
                if when and done[f] is None:
                    done[f] = m.get(f)
        m.update({f: v for f, v in done.items() if v is not None})
        out.append((t["session"], t["turn"], *done.values()))
    return out


def test_session_complete(spark):
    r = random.Random(5)
    maybe = lambda *values: r.choice([None, *values])
    turns = [
        {"session": s, "turn": i, "corp": maybe("A", "B"), "year": maybe(2020, 2023), "account": maybe("x"), "scope": maybe("FY", "HY"), "statement": maybe("IS"), **{f: r.random() < 0.3 for f in ("pronoun", "compare", "back", "switch")}}
        for s in (1, 2, 3) for i in range(r.randint(1, 400))
    ]
    frame = spark.createDataFrame(turns, "session bigint, turn int, corp string, year int, account string, scope string, statement string, pronoun boolean, compare boolean, back boolean, switch boolean")
    assert sorted(map(tuple, session.complete(frame.repartition(5)).collect()), key=str) == sorted(plain_complete(turns), key=str)


def test_chunk_recursive(spark, sf):
    want = []
    for d in sections(spark, sf).select("doc_id", "text").collect():
        pieces = [d.text] if len(d.text) <= 3000 else split_text(d.text, 3000, 300)
        want += [(d.doc_id, i, p) for i, p in enumerate(pieces)]
    assert sorted(map(tuple, chunk_recursive(spark, sf).collect())) == sorted(want)
    assert all(len(p) <= 3000 for _, _, p in want)

import random

import pytest
from pyspark.sql import functions as F

from factlake.operators import aliases, routing
from factlake.sources import filings


def plain(texts, names):
    out = {}
    for key, text in texts:
        hits = [(-len(a), a, n) for a, n in names if a and text and a in text]
        if hits:
            out[key] = min(hits)[1:]
    return out


def ran(spark, texts, names, most=aliases.SMALL_ROWS):
    rows = aliases.longest_in(spark.createDataFrame(texts, "k long, t string"), "k", F.col("t"), spark.createDataFrame(names, "alias string, name string"), most)
    return {r.k: (r.alias, r.name) for r in rows.collect()}


@pytest.mark.parametrize("most", [aliases.SMALL_ROWS, 0])
def test_against_every_alias(spark, most):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abé한😀") for _ in range(n))
    names = [(word(rng.randint(1, 9)), f"n{i}") for i in range(300)] + [("", "empty"), (None, "null")]
    texts = [(i, word(rng.randint(0, 40))) for i in range(200)] + [(900, None), (901, ""), (902, word(700)), (902, "한" * 3)]
    texts += [(i, t + names[i][0] + t) for i, t in [(n, "zzz" * rng.randint(0, 100)) for n in range(1000, 1000)]]
    at_edges = [(2000 + i, "-" * i + "needlework") for i in range(100, 150)]  # an alias across every cut
    names += [("needlework", "edge"), ("needle", "shorter")]
    got = ran(spark, [t for t in texts if t[0] != 902] + at_edges + [(902, texts[-2][1])], names, most)
    assert got == plain([t for t in texts if t[0] != 902] + at_edges + [(902, texts[-2][1])], names)
    assert all(got[k] == ("needlework", "edge") for k, _ in at_edges)


def test_a_hundred_thousand_aliases_and_a_hot_one(spark):
    names = [(f"company{i:06d}", str(i)) for i in range(100_000)] + [("co", "short")]
    texts = [(i, f"about company{(7 * i) % 120_000:06d} and others") for i in range(3000)] + [(i, "the co itself") for i in range(3000, 6000)]
    got = ran(spark, texts, names)
    assert len(got) == 6000
    assert all(got[i] == ((f"company{(7 * i) % 120_000:06d}", str((7 * i) % 120_000)) if (7 * i) % 120_000 < 100_000 else ("co", "short")) for i in range(3000))


def test_no_aliases_and_no_texts(spark):
    assert ran(spark, [(1, "x")], []) == {} and ran(spark, [], [("x", "y")]) == {}


def test_routing_takes_a_table_of_names(spark):
    names = {"corp": [("Acme", "A"), ("Acme Energy", "E")], "account": [("Netsales", "revenue")], "sector": [], "term": [("ROE", "ROE")]}
    asked = spark.createDataFrame([(1, "Acme Energy Net sales 2024년 연간"), (2, "Acme 최근 뉴스"), (3, "ROE 뜻")], "qid long, text string")
    tables = names | {f: spark.createDataFrame(names[f], "alias string, name string") for f in ("corp", "account")}
    one, two = (sorted(map(tuple, routing.route(asked, n).select(*routing.route(asked, names).columns).collect())) for n in (names, tables))
    assert one == two and [r[1] for r in one] == ["E", "A", None]


def test_known_companies_in_file_names(spark):
    rows = spark.createDataFrame([("x/[Foo]_AcmeEnergy_2024.xml", "Foo"), ("x/[Bar]_1.xml", "Bar"), ("x/[Bar]_1.xml", "Bar")], "source_file string, corp_name string")
    known = spark.createDataFrame([("Acme", "A"), ("AcmeEnergy", "E")], "alias string, name string")
    assert sorted(r.corp_name for r in filings.with_companies(rows, known).collect()) == ["Bar", "Bar", "E"]


@pytest.mark.parametrize("bits", [aliases.MAP, aliases.BLOCK])
def test_a_map_that_lets_too_much_through_loses_nothing(spark, monkeypatch, bits):
    """With one block for thousands of aliases almost any part may be one; texts are cut into many pieces."""
    monkeypatch.setattr(aliases, "MAP", bits)
    monkeypatch.setattr(aliases, "PIECE", 64)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdeé한😀") for _ in range(n))
    names = [(word(rng.randint(4, 12)), f"n{i}") for i in range(5000)] + [("x" * 40, "long"), ("x" * 40 + "yz", "longer"), ("x" * 31, "under"), ("x" * 32, "at")]
    texts = [(i, word(rng.randint(0, 200))) for i in range(150)] + [(200 + n, word(70) + "x" * n + word(70)) for n in range(28, 44)] + [(300, "x" * 41 + "yz"), (301, None), (302, "")]
    rows, known = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(names, "alias string, name string")
    got = {r.id: (r.alias, r.name) for r in aliases.longest_in(rows, "id", F.col("t"), known, 0).collect()}
    assert got == plain(texts, names)
    every = [tuple(r) for r in aliases.contained(rows, "id", F.col("t"), known, 0).collect()]
    assert sorted(every) == sorted({(k, a, n) for k, t in texts for a, n in names if t and a in t})

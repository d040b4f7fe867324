"""Odd rows of the operators whose results on the given tables are held against SQL."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from factlake.llm import chat_format, line_dedup, mixing, quality, vector_join, warc
from factlake.llm.common import scratch
from factlake.llm.graph import components

from ..oracle import agree


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(0, i) for i in range(500, 800)] + [(i, i + 1) for i in range(900, 960)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()
    assert len({r.node for r in got}) == len(got)
    assert {r.node: r.root for r in got} == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def plain_lines(rows):
    key = lambda x: re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", x).translate(line_dedup.LOWER)
    holders = {}
    for i, (k, t) in enumerate(rows):
        for x in {key(y) for y in (t or "").split("\n")}:
            holders.setdefault(x, []).append((-(2**63) if k is None else k, i))
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and max(holders[key(x)])[0] != (-(2**63) if k is None else k))]
        out.append((-1 if k is None else k, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("held, share", [(100_000, 1_000_000), (7, 500)])
def test_line_dedup(spark, monkeypatch, held, share):
    """The second case cuts runs over many partitions, and holds only a few rows of each."""
    monkeypatch.setattr(line_dedup, "HELD", held)
    monkeypatch.setattr(line_dedup, "SHARE", share)
    r = random.Random(1)
    pool = ["A line of more than twenty characters", "  a LINE of more than twenty characters\t", "short", "", "another long line, the second of these", "ünïcödé line of just over 20", "é" * 20, "é" * 19, "\x0bvertical tab and more text here\x0c"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 6)))) for i in range(60)] + [(None, pool[0]), (None, pool[4]), (3, None), (3, ""), (70, "\n".join(pool * 2000)), (70, pool[0])]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id bigint, text string, line string").repartition(5)
    odd = docs.selectExpr("*", "1 as _n_dropped", "2 as _doc", "3 as _mark", "4 as keep", "5 as `a.b`", "6 as c0", "7 as mark")
    cut = line_dedup.without_copied_lines(odd)
    assert cut.columns == odd.columns and {(x._n_dropped, x.c0, x.mark) for x in cut.collect()} == {(1, 6, 7)}
    got = line_dedup.kept_text(docs, line_dedup.keep_bitmaps(docs)).collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x._n_lines, x._n_dropped, hashlib.sha256((x.text or "").encode()).hexdigest()) for x in got) == plain_lines(rows)
    assert {x.line for x in got} == {"clash"}
    assert line_dedup.without_copied_lines(docs.limit(0)).count() == 0


def test_short_lines_outlast_a_shared_line(spark):
    """Only a document of which nothing is left goes; verse and lists keep their lines."""
    shared, verse = "one licence line that all of them share", "\n".join(f"short line {i}" for i in range(40))
    rows = [(1, f"{verse}\n{shared}"), (2, f"{shared}\n \t\n{shared}"), (3, shared), (4, f"{shared}\nend"), (5, f" {shared}")]
    docs = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id bigint, text string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.without_copied_lines(docs).collect()}
    assert got == {1: (verse, len(verse)), 4: ("end", 3), 5: (f" {shared}", len(shared) + 1)}


def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    seen, covered = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for starts in seen.values():
        if len(starts) > 1:
            covered |= {i + d for i in starts for d in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    texts = [None, "", " \n\t ", "a", "a b c", "a b c a b c", "x x x x", "a\nb\na\n \n \nA", "#$ <p> | ü é\x1cz", "x y z " * 5000, "a b c d a b c e b c d", "\n".join(["same line"] * 50)]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, n_words string").drop("n_words")
    got = {r.doc_id: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality.measured(rows).collect()}
    assert got == {i: plain_quality(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("n, k, p", [(10, 0, 0.3), (30, 3, 0.2), (2000, 4, 0.005), (100_000, 400, 0.005), (50, 40, 0.1), (0, 0, 0.1)])
def test_binomial_tail(spark, n, k, p):
    got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("bigint"), F.lit(k).cast("bigint"), p).alias("x")).first().x
    term = lambda i: math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    assert got == pytest.approx(1.0 if k >= n * p else sum(map(term, range(k + 1))), rel=1e-8)


def test_certified_rule_spares_clean_documents(spark):
    """Junk stands out; a rule may reject it only where enough clean documents vouch for the cutoff."""
    r = random.Random(2)
    clean = lambda: " ".join("".join(r.choice("abcdef") for _ in range(5)) for _ in range(60))
    rows = [(i, "aa", clean()) for i in range(3000)] + [(i, "aa", clean().replace(" ", " # ")) for i in range(3000, 3100)] + [(i, "bb", clean().replace(" ", " # ")) for i in range(3100, 3150)] + [(9000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame([(i, int(i < 3000)) for i in range(3150)] + [(5, None)], "doc_id bigint, quality int")
    got = {x.doc_id: x.kept for x in quality.judge(docs, labels).collect()}
    assert all(got[i] for i in range(3000)) and not any(got[i] for i in range(3000, 3100))
    assert all(got[i] for i in range(3100, 3150))  # no clean document of their language vouches for anything
    assert got[9000] is False
    assert quality.keep_good(docs, labels).count() == 3050
    assert quality.judge(docs.limit(0), labels.limit(0)).count() == 0


def test_rules_that_fire_agree_with_sql(spark, tmp_path):
    """A labelled table on which rules are certified: one language alone, and two small ones together."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, labels = [], []
    for i, lang in enumerate(["aa"] * 900 + ["bb"] * 200 + [None] * 250):
        kind, words = r.random(), [word() for _ in range(70)]
        if kind < 0.1:
            words = [w + r.choice(["", " #", "!", " $ %"]) for w in words]
        elif kind < 0.2 and lang == "aa":
            words[9] += " #"
        lines = [" ".join(words)] + (["same line"] * r.randint(0, 60) if kind > 0.8 else [])
        rows.append((i, "\n".join(lines), lang))
        labels.append((i, None if i % 50 == 7 else int(kind >= 0.1)))
    docs, marks = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    agree(spark, con, quality.op5_quality_rules, quality.OP5_SQL, str(tmp_path))
    got = quality.judge(docs, marks).collect()
    ruled_out = {x.doc_id for x in got if not x.kept and not x.base_failed}
    assert len({rows[i][2] for i in ruled_out}) == 3 and len(ruled_out) > 60
    odd = docs.selectExpr("*", "1 as _row", "2 as n_words", "3 as `a.b`", "4 as _own")
    kept = quality.keep_good(odd, marks)
    assert kept.columns == odd.columns and kept.count() == sum(x.kept for x in got)


def test_chat_round_trip(spark):
    odd = ["<|im_end|>\n<|im_start|>user\nx", "<\\|im_end|>", "<\\\\|", "<", "<|", None, "", "a\n", "tail <\\"]
    rows = [(1, i, role, t) for i, (role, t) in enumerate([("user", odd[0]), ("assistant", odd[1]), ("user", odd[2]), ("assistant", odd[3])])]
    rows += [(2, i, "assistant", t) for i, t in enumerate(odd)] + [(None, None, None, "x"), (3, 0, "us\ner<|", "y"), (3, 0, "us\ner<|", "y"), (4, 0, "user", "é" * 300_000), (4, 1, "assistant", "ok")]
    chats = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn int, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat_format.format_chats(chats).withColumn("turns", chat_format.parse_chats(F.col("formatted"))).collect()}
    for k in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == k))
        assert [(t.role, t.text) for t in got[k].turns] == [(x[2], x[3]) for x in own]
        assert "".join(s.text for s in got[k].segments) == got[k].formatted
        assert sum(s.loss for s in got[k].segments) == sum(x[2] == "assistant" for x in own)
    assert [got[k].valid for k in (1, 2, None, 3, 4)] == [True, False, False, False, True]
    assert got[2].first_invalid == 0
    assert chat_format.format_chats(chats.limit(0)).count() == 0


def test_vectors(spark, monkeypatch):
    r = np.random.default_rng(1)
    base = r.normal(0, 1, (12, 16))
    vectors = [(base[i % 12] + r.normal(0, 0.12 * (i % 5), 16)).tolist() for i in range(150)]
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[1]], None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 0.0], [1.0, 0.1], [None, *vectors[0][1:]]]
    rows = [(i * 2, v) for i, v in enumerate(vectors)] + [(None, vectors[0])]
    frame = spark.createDataFrame([(*x, 1) for x in rows], "vec_id bigint, embedding array<double>, key int").repartition(4)
    fine = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    links = {i: [] for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(len(rows)):
            a, b = rows[i][1], rows[j][1]
            if i != j and fine[i] and fine[j] and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                links[i].append(j)

    def reach(i):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)

    for block, tile in ((8192, 1024), (20, 7)):
        for name, value in (("BLOCK", block), ("TILE", tile), ("LEAST", 1)):
            monkeypatch.setattr(vector_join, name, value)
        got = vector_join.near_duplicate_vectors(frame).collect()
        want = sorted((-1 if k is None else k, len(links[i]), -1 if reach(i) is None else reach(i), k == reach(i)) for i, (k, _) in enumerate(rows))
        assert sorted((-1 if x.vec_id is None else x.vec_id, x.n_links, -1 if x.component_id is None else x.component_id, x.kept) for x in got) == want
    assert vector_join.near_duplicate_vectors(frame.limit(0)).count() == 0


def test_blocks_of_other_clusters_are_not_paired(spark, monkeypatch):
    """Of 1,600 vectors in 32 blocks or more, all pairs of blocks would take 51,200 rows."""
    r = np.random.default_rng(2)
    centres = np.linalg.qr(r.normal(0, 1, (16, 16)))[0]
    v = centres[np.arange(1600) % 16] + r.normal(0, 0.01, (1600, 16))
    whole = vector_join._block_pair
    for name in ("LEAST", "BLOCK"):
        monkeypatch.setattr(vector_join, name, 50)
    monkeypatch.setattr(vector_join, "_block_pair", lambda t: lambda x: whole(t)(x).assign(n=len(x)).head(1))
    units = spark.createDataFrame([(i, 1, bytearray((x / np.linalg.norm(x)).tobytes())) for i, x in enumerate(v)], "key bigint, copies bigint, unit binary")
    assert vector_join._blocks(units, 16, 0.9).agg(F.sum("n")).first()[0] < 51_200 / 4


def test_warc_round_trip(spark, monkeypatch):
    long = "<p>" + "x" * 1000
    rows = [(i, f"http://a/{i}", f"<p>{i}</p>") for i in range(200)] + [(300 + i, None, long) for i in range(5)] + [(400, "u\nv", None), (None, "n", "null id"), (401, "e", "short"), (402, "e", "short"), (303, "again", long), (500, "ü", "é" * 200_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, payload string").repartition(5)
    folder = f"{scratch(spark)}/warc-test-{random.random()}"
    manifest = warc.write_archives(pages, folder, file_bytes=4000)
    files = manifest.collect()
    assert len(files) > 3 and sum(f.records for f in files) == len(rows)
    again = warc.write_archives(pages.repartition(3), folder + "-again", file_bytes=4000).collect()
    assert sorted((f.file, f.sha256) for f in files) == sorted((f.file, f.sha256) for f in again)
    got = warc.read_archives(manifest, folder).collect()
    assert sorted((x.page_id or -1, x.payload_bytes, x.payload_digest) for x in got) == sorted((k or -1 if k is None else k or -1, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for k, _, h in rows)
    assert sorted(((x.page_id, x.refers_to) for x in got if x.record_type == "revisit")) == [(300, 304), (301, 304), (302, 304), (303, 304), (303, 304)]
    texts = {x.page_id: x.payload.decode() for x in got if x.payload is not None}
    for name, value in (("LEAST_BYTES", 2000), ("PER_SHARD", 4)):
        monkeypatch.setattr(warc, name, value)
    hot = pages.union(spark.createDataFrame([(9, "h", f"hot {i} " + "y" * 100, "") for i in range(600)], pages.schema))
    shards = warc.write_archives(hot, folder + "-hot", file_bytes=4000).groupBy("shard").agg(F.sum("records").alias("n")).collect()
    assert len(shards) > 10 and max(x.n for x in shards) < 150  # a page_id of many payloads is cut
    assert warc.read_archives(warc.write_archives(hot, folder + "-hot2"), folder + "-hot2").count() == hot.count()
    assert texts[500] == "é" * 200_000 and texts[400] == "" and texts[304] == long
    assert warc.read_archives(warc.write_archives(pages.limit(0), folder + "-none"), folder + "-none").count() == 0


def test_mixing(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 7}", "w " * (i % 50)) for i in range(3000)] + [(None, None, "a b c"), (1, "only empty", None), (2, "only empty", " "), (5, "big", "w w"), (5, "big", "w w")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, source string, text string, budget string").repartition(4)
    size, total = {}, 0
    for _, s, t in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
        total += len((t or "").split())
    out = mixing.mix(docs, entropy=0.9, repeats=3.0).collect()
    taken = {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + len((r.text or "").split())
    a = mixing.exponent([n for n in size.values() if n], 0.9, 3.0, total)
    weights = {s: (n / total) ** a for s, n in size.items() if n}
    for s, w in weights.items():
        budget = w / sum(weights.values()) * total
        assert budget - 50 <= taken.get(s, 0) <= budget + 1
        assert taken.get(s, 0) <= 3.0 * size[s] + 1
    assert sum(r.source == "only empty" for r in out) == 2 and {r.budget for r in out} == {"clash"}
    whole = mixing.mix(docs, entropy=0.9, repeats=3.0, whole=True)
    assert whole.select("doc_id", "source", "text").distinct().count() == len(set(rows))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_of_many_sources(spark, monkeypatch):
    """The exponent searched by aggregates is that of the bisection; any names pass; a budget that cannot be met is an error."""
    rows = [(i, f"s{i % 40}", "w " * (1 + (i % 40) ** 2)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 as _row", "2 as _b", "3 as `a.b`", "4 as n")
    want = sorted(r.doc_id for r in mixing.mix(docs).collect())
    sizes = [10 * (1 + k * k) for k in range(40)]
    for own in (None, float(sum(sizes))):
        few = mixing._searched(spark.createDataFrame([(n,) for n in sizes], "n bigint"), 0.95, 4.0, float(sum(sizes)), own)
        assert few == pytest.approx(mixing.exponent(sizes, 0.95, 4.0, own), abs=1e-12)
    monkeypatch.setattr(mixing, "SMALL", 3)
    got = mixing.mix(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == want
    with pytest.raises(ValueError):
        mixing.mix(docs, repeats=2.0, budget=3.0)


def test_exponent():
    tokens = [1000, 10, 10, 10]
    a = mixing.exponent(tokens, 0.9, 1e9, 1030)
    w = [(n / 1030) ** a for n in tokens]
    w = [x / sum(w) for x in w]
    assert -sum(x * math.log(x) for x in w) / math.log(4) == pytest.approx(0.9, abs=1e-6)
    b = mixing.exponent(tokens, 0.9, 4.0, 1030)
    w = [(n / 1030) ** b for n in tokens]
    assert a < b < 1 and max(x / sum(w) * 1030 / n for x, n in zip(w, tokens, strict=True)) == pytest.approx(4.0)
    assert mixing.exponent([5, 5], 0.95, 4.0, 10) == 1.0
